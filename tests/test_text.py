"""Scalar functions against inline cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from grafonda.functions import text as T
from grafonda.functions import udfs
from grafonda.functions.plainform import plain, title_key


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_windows(spark):
    got = one(spark, T.windows(F.col("t"), 50, 10), t="a" * 200)
    assert len(got) > 1 and len(got[0]) == 50 and len(got[-1]) <= 50
    assert one(spark, T.windows(F.col("t")), t="  \n ") == []
    assert one(spark, T.windows(F.col("t")), t="ab  c") == ["ab c"]


@pytest.mark.parametrize("name,clean,hint", [("Eureka (word)", "Eureka", "word"), ("Eureka (word", "Eureka", "word"), ("Sacramento, California", "Sacramento, California", ""), ("(x)", "(x)", "")])
def test_disambiguation(spark, name, clean, hint):
    got = one(spark, T.disambiguation(F.col("t")), t=name)
    assert (got["clean"], got["hint"]) == (clean, hint)


@pytest.mark.parametrize(
    "name,kind",
    [("Sacramento, California", "Location"), ("John Smith", "Person"), ("A B C D E", "Unknown"), ("Đại học Huế", "Organization"), ("Los Angeles", "Location"), ("Nguyễn Trãi", "Person"), ("tỉnh Nghệ An", "Location"), ("Truyện Kiều", "Work"), ("Hà Nội FC", "Organization")],
)
def test_entity_type(spark, name, kind):
    assert one(spark, T.entity_type(F.col("t")), t=name) == kind


def test_markup(spark):
    text = "'''Huế''' là [[thành phố|TP]] <ref>x</ref> ở [[Việt Nam]]. {{a{{b}}c}}[[Tập tin:a.jpg]] == Sử =="
    assert one(spark, T.strip_markup(udfs.strip_templates("t")), t=text) == "Huế là TP ở Việt Nam. == Sử =="
    assert udfs.balanced_removed("a {{b {{c}} d}} e {{f") == "a  e "


def test_wikilinks(spark):
    got = one(spark, T.wikilinks(F.col("t")), t="[[hà Nội#Sử|thủ đô]] [[Hà_Nội]] [[File:x]] [[ Huế ]]")
    assert [(x["target"], x["display"]) for x in got] == [("Hà Nội", "thủ đô"), ("Huế", "Huế")]


def test_names(spark):
    got = one(spark, T.simple_names(F.col("t")), t="Vint Cerf met Bob Kahn. vint cerf, VINT; Vint Cerf")
    assert got == ["Vint Cerf", "Bob Kahn"]


def test_answers(spark):
    assert one(spark, T.answer_spaced(F.col("t")), t="Hà-Nội!") == "hà nội"
    assert one(spark, T.answer_bare(F.col("t")), t="Hà-Nội!") == "hànội"
    assert one(spark, T.answer_untailed(F.col("t")), t=" Hà Nội. ") == "hà nội"
    assert one(spark, T.answer_unbracketed(F.col("t")), t="Huế (cũ)") == "huế"
    assert one(spark, T.first_number(F.col("t")), t="có 1,234 người") == "1234"


def test_uuid5(spark):
    assert one(spark, T.uuid5(F.col("t")), t="https://a/ệ") == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a/ệ"))
    assert one(spark, T.uuid5(F.col("t"), "dns"), t="huế") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "huế"))


def test_grounded(spark):
    g = T.grounded(F.col("n"), F.col("n"), F.col("t"))
    assert one(spark, g, n="Hồ Chí Minh", t="chủ tịch chí minh")
    assert one(spark, g, n="Nguyễn Văn Trỗi", t="về nguyễn trỗi")
    assert not one(spark, g, n="Nguyễn Văn Trỗi", t="nguyễn và trỗi")
    assert not one(spark, g, n=" ", t="nguyễn")
    assert not one(spark, T.grounded(F.col("n"), F.col("n"), F.col("t"), True), n="Năm", t="nămx")
    assert one(spark, g, n="Năm", t="nămx")
    assert not one(spark, g, n="Huế", t="Hà Nội")


def test_aliases(spark):
    assert one(spark, T.aliases_in(F.col("n"), F.col("t")), n="Huế", t="Huế (Phú Xuân) và Huế (huế) và Huế (x)") == ["Phú Xuân"]


def test_question_reading(spark):
    names = T.question_entities(F.col("t"))
    assert one(spark, names, t="Ai cho Lê Lợi hay Trãi") == ["Lê Lợi", "Trãi"]
    assert one(spark, names, t="vì sao mua to nay thay") == ["mua to nay"] and one(spark, names, t="") == []
    t = T.question_template(F.col("t"))
    assert tuple(one(spark, t, t="Mối quan hệ giữa Huế và Hà Nội")) == ("two_entity_intersection", "Huế", "Hà Nội")
    assert tuple(one(spark, t, t="Huế là gì"))[:2] == ("find_entity", "Huế")
    assert "lower('O''Brien')" in one(spark, T.template_query(t), t="O'Brien là ai")
    assert one(spark, T.vietnamese_names(F.col("t")), t="Lê Lợi, lê lợi và Nguyễn Trãi; Lê Lợi. Huế") == ["Lê Lợi", "Nguyễn Trãi"]


def test_patterns(spark):
    noise = T.is_noise(F.col("t"))
    for t, want in (("năm 2017", True), ("Trước đây", False), ("trước", True), ("1984", True), ("FC Hà Nội", False), ("Danh sách tỉnh", True), ("Huế", False)):
        assert one(spark, noise, t=t) is want
    surface = T.any_match(F.col("t"), T.L.ORG_SURFACE)
    assert one(spark, surface, t="Hà Nội FC") and one(spark, surface, t="Acme Inc") and not one(spark, surface, t="Lincoln")


def test_sentences_and_sections():
    assert udfs.sentences("Ở TP. Huế. Có PGS. Lê. Hết") == ["Ở TP. Huế.", "Có PGS. Lê.", "Hết"]
    assert udfs.sections("mở\n== A ==\nx\n=== B ===\ny\n== C ==\n") == [("", "mở"), ("A", "x"), ("A > B", "y")]


def test_structured_chunks():
    text = "== A ==\n" + "\n\n".join("Câu này dài. " * 40 for _ in range(6))
    got = udfs.structured_chunks(text, "T")
    assert all(len(c["text"]) <= 1600 and c["context"] == "[Page: T | Section: A] " for c in got)
    assert [c["seq"] for c in got] == list(range(len(got))) and len(got) > 1
    assert udfs.structured_chunks(None, None) == [] and udfs.structured_chunks(" ", "T") == []


def test_split_sizes():
    import random

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["từ", " ", " ", ". ", "\n\n", "dài" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 120)))
        got = udfs.split_to_size(text, 50, 10)
        assert all(0 < len(p) <= 50 for p in got)
        assert "".join("".join(got).split()) == "".join(text.split())
    assert udfs.split_to_size("a b\n\nc d", 5, 0) == ["a b", "c d"] and udfs.split_to_size("x" * 7, 3, 0) == ["xxx", "xxx", "x"]
    assert udfs.split_to_size("aaaa bbbb c", 9, 3) == ["aaaa bbbb", "c"] and udfs.split_to_size("aaa bbbbb c", 7, 3) == ["aaa", "bbbbb c"]


def test_plain():
    assert plain("Đà-Nẵng  2") == "da nang 2" and plain(None) == ""
    assert title_key(" Hà_Nội  cũ ") == "hà nội cũ"


def test_nulls(spark):
    for f in (T.collapse, T.windows, T.simple_names, T.wikilinks, T.strip_markup, T.disambiguation, T.entity_type, T.key_terms, T.paragraphs):
        spark.createDataFrame([(None,), ("",)], "t string").select(f(F.col("t"))).collect()
