"""Filler pages."""

import pytest

from grafonda.llm import spam as S

ARTICLE = (
    "Ngôi đình cổ ở phủ Đếch Gạnh được dựng năm 1827, trùng tu lần gần nhất năm 1586. Dù gặp nhiều khó khăn, ông vẫn kiên trì theo đuổi nghề làm gốm. "
    "Trận lụt năm 1768 đã cuốn trôi gần 899 nóc nhà ở vùng hạ lưu, và người dân phải rời khỏi làng. Tên gọi này xuất hiện lần đầu trong một văn khế cũ.\n\n"
    "Khí hậu chia thành hai mùa rõ rệt, với lượng mưa lớn. Chiều dài của sông là 403 km, nơi đây đã là chốn trao đổi muối giữa miền xuôi và miền ngược.\n"
)
KEYWORDS = ", ".join(f"{a} {b}" for a in ("mua", "bán", "báo giá", "review") for b in ("trà sen giá rẻ", "nồi đất online", "trà sen uy tín", "nồi đất chính hãng", "đèn lồng 2024"))
LINKS = "\n".join(f"[http://hot-{i}.example/p/{i} nón quai]" for i in range(20))
PRODUCTS = "\n".join(f"MS-{i} | {'đèn lồng' if i % 2 else 'dao rèn'} | màu nâu | {i}.000đ | còn hàng" for i in range(100, 120))
DRESSED = " ".join(f"{a.capitalize()} trà sen giá rẻ, {b} đèn lồng online." for a in ("mua", "bán", "xem", "kho") for b in ("mua", "review", "sửa", "top"))
LISTED = "\n".join("* " + s.strip() + "." for s in ARTICLE.replace("\n", " ").split(".") if s.strip()) + "\n# [https://x.example/a Nguồn]\n[[Thể loại:Di sản]]\nThể loại: Văn hoá, Di sản"
REPEATED = "Sông Hồng chảy qua vùng này. Dân gọi sông Hồng là sông Cái vì nó lớn. Khi sông Hồng dâng, người ta đắp đê bên sông Hồng và chờ nước của sông rút. " * 3


@pytest.mark.parametrize("text", [KEYWORDS, LINKS, PRODUCTS, DRESSED, KEYWORDS.replace(", ", "\n"), "nón quai | chiếu cói | nón quai | " * 12, "buy rush mats now, cheap rush mats, rush mats online, best rush mats 2020, " * 4, "#mua_tra_sen #bangnoidat #trasenonline " * 10, ARTICLE[:120] + "\n" + KEYWORDS])
def test_filler(text):
    assert S.filler_share([text], S.Terms())[0] > 0.5


@pytest.mark.parametrize("text", [ARTICLE, LISTED, REPEATED, "", "xin chào", ARTICLE * 3 + "\n" + KEYWORDS[:150]])
def test_articles(text):
    assert S.filler_share([text], S.Terms())[0] <= 0.5


def test_documents_do_not_meet():
    together = S.filler_share([ARTICLE, KEYWORDS, "", LINKS], S.Terms(limit=10))
    alone = [S.filler_share([t], S.Terms())[0] for t in (ARTICLE, KEYWORDS, "", LINKS)]
    assert together.tolist() == pytest.approx(alone)


def test_table(spark):
    df = spark.createDataFrame([(1, KEYWORDS, 1), (1, KEYWORDS, 1), (2, ARTICLE, 1), (3, None, 1), (4, "", 1), (None, KEYWORDS, 1), (5, ARTICLE * 500, 1)], "doc_id long, text string, share int")
    assert [r["id"] for r in S.filler_pages(df).collect()] == [1]
    assert S.filler_pages(df, above=None).count() == 5
    assert S.filler_pages(df.limit(0)).count() == 0


def test_other_scripts_are_no_filler():
    text = "Город стоит на берегу реки и известен своими мастерами. В начале века здесь построили первый мост, а потом и школу. Жители помнят наводнение, которое разрушило старую площадь, и каждый год приходят к памятнику. "
    assert S.filler_share([text, text + text.replace("мост", "вокзал").replace("реки", "моря")], S.Terms()).max() < 0.5
