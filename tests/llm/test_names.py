"""Linking of name variants."""

import pytest

from grafonda.llm import names as N

REGISTRY = [
    ("p1", "Khuất Chén Khề", "Person", ["Hai Mích Bơi", "Hai Mích Bơi"]),
    ("p2", "Doãn Gion Đen", "Person", None),
    ("p3", "Doãn Ngồng Khiêm", "Person", []),
    ("o1", "Ngân hàng Viếng Sông ", "Organization", ["NHVS12"]),
    ("o2", "Bệnh viện Đa khoa Nhòn Dem", None, [None, ""]),
    ("l1", "Huyện Nghiều Nhượt", "Location", None),
    ("w1", "Bài ca hặng cượng", "Work", None),
    ("w1", "Bài ca hặng cượng", "Work", None),
    (None, "Không Ai Cả", "Person", None),
    ("nul", None, "Person", None),
]


@pytest.mark.parametrize(
    "text,entity",
    [
        ("Khuất Chén Khề", "p1"), ("KHUẤT CHÉN KHỀ", "p1"), ("Khuat Chen Khe", "p1"), ("KhuấtChénKhề", "p1"), ("Khuất  Chén-Khề.", "p1"), ("ông Khuất Chén Khề", "p1"), ("PGS. Khuất Chén Khề", "p1"),
        ("Chén Khề", "p1"), ("Khuất Khề", "p1"), ("K. C. Khề", "p1"), ("KC Khề", "p1"), ("Kh. Chén Khề", "p1"), ("Khề, Khuất Chén", "p1"), ("Khuất Chéén Khề", "p1"), ("Khuấ tChén Khề", "p1"), ("Khuất Chxn Khề", "p1"), ("Hai Mich Boi", "p1"),
        ("Doãn G. Đen", "p2"), ("NH Viếng Sông", "o1"), ("Viếng Sông, Ngân hàng", "o1"), ("Viếng Sông (ngân hàng)", "o1"), ("Viếng Sông", "o1"), ("nhvs12", "o1"), ("BVĐK Nhòn Dem", "o2"), ("BV Nhòn Dem", "o2"), ("H. Nghiều Nhượt", "l1"), ('"huyện nghiều nhượt"', "l1"), ("hặng cượng", "w1"), ("tác phẩm Bài ca hặng cượng", "w1"),
        ("Câu lạc bộ Nhòn Dem", None), ("Khuất Chén Rộp", None), ("Doãn Ngồng Phoác", None), ("Doãn", None), ("Khuất Chẹn", None), ("Không Ai Cả", None), ("NHVS13", None), ("...", None), ("", None), (None, None),
    ],
)
def test_variants(spark_links, text, entity):
    assert spark_links.get(text) == entity


@pytest.fixture(scope="module")
def spark_links(spark):
    texts = [c[0] for c in _cases()]
    mentions = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "Khuất Chén Khề", "x", 1)], "mention_id long, text string, entity string, id int")
    registry = spark.createDataFrame(REGISTRY, "entity_id string, canonical_name string, text string, aliases array<string>")
    got = {r["id"]: r["entity"] for r in N.link_names(mentions, registry).collect()}
    assert N.link_names(mentions.limit(0), registry).count() == 0 and N.link_names(mentions, registry.limit(0)).count() == 0
    return {t: got.get(i) for i, t in enumerate(texts)}


def _cases():
    return test_variants.pytestmark[0].args[1]


def test_deletes_reach_one_edit():
    for a, b in (("chén", "chen"), ("abcd", "abd"), ("abcd", "acbd"), ("abcd", "abxcd"), ("abcd", "abxd")):
        assert N.deletes(a) & N.deletes(b) and N.edits(a, b) == 1
    assert N.edits("abcd", "abcd") == 0 and N.edits("abcd", "wxyz") == 3
