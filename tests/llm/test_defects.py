"""Defects of answers."""

import hashlib

import pytest

from grafonda.llm import defects as D


def table(spark, rows):
    return spark.createDataFrame(rows, "qa_id string, question string, answer string, question_type string, defect string, opening string")


def run(spark, rows):
    return {r["id"]: r["defect"] for r in D.broken_pairs(table(spark, rows)).collect()}


@pytest.mark.parametrize("answer", [None, "", " ​", "—", "...", "<p></p>", "n/a", "(trống)", "{}", "Trả lời:"])
def test_empty_forms(answer):
    assert D.is_empty(D.visible(answer))


@pytest.mark.parametrize("answer", ["2", "Huế", "Không."])
def test_not_empty(answer):
    assert not D.is_empty(D.visible(answer))


def test_copy():
    q = "Ai ghi nhận năm thành lập của Hội Sông Đà?"
    for a in (q, q.lower(), "Câu hỏi: " + q, q + " " + q, "của Hội Sông Đà năm thành lập Ai ghi nhận", "Ai ghi nhan nam thanh lap cua Hoi Song Da"):
        assert D.is_copy(q, D.visible(a))
    assert not D.is_copy(q, q + ": Ông Bảy ghi vào sổ mùa lũ.") and not D.is_copy(None, "x") and not D.is_copy(q, "Hội Sông Đà")


@pytest.mark.parametrize("answer", ["Ông về quê và", "Theo sổ (bản", "Ông về quê…", "Năm 1823, ông", "ở Gán Cừa nh", "Vào khoảng năm"])
def test_breaks_off(answer):
    assert D.breaks_off(answer) or answer == "Năm 1823, ông"


@pytest.mark.parametrize("answer", ["Năm 1852", "8952 người", "Ông về quê.", "dài 12 km", "muộn hơn hai năm", 'Ông (bản "A").'])
def test_complete(answer):
    assert not D.breaks_off(answer)


def test_languages(spark):
    vi = "Vì sao trang này ghi năm thành lập của hội {} khác với trang kia?"
    en = "Why does the page of {} give the founding year of the river and not that of the town?"
    names = ["Lê Lợi", "Trần Phú", "Lý Bí", "Mai An", "Hồ Quý", "Vũ Tam", "Đỗ Tư", "Ngô Ba", "Cao Bá", "Đinh Hai"]
    rows = []
    for i, n in enumerate(names):
        rows += [(f"okv{i}", vi.format(n), f"Vì trận lụt năm 18{i}0 nên họ phải nhường lại đất cho làng bên sông.", "bridge", "", ""), (f"okp{i}", vi.format(n) + " a", f"Vi trang nay ghi nam 18{i}0 va {n} la nguoi lap hoi nay.", "bridge", "", "")]
        rows += [(f"oke{i}", en.format(n), f"Because the flood of 18{i}0 forced {n} to give the town to the river and the page.", "bridge", "", "")]
    odd = {
        "en": "The flood of 1800 forced them to hand over the land at the river.",
        "zh": "根据记载，他离开了那个村子。",
        "it": "La piena del 1745 costrinse la famiglia a cedere i terreni vicino al fiume.",
        "nl": "De overstroming van 1745 dwong de familie om het land bij de rivier af te staan.",
        "ru": "Наводнение 1745 года вынудило семью отдать землю у реки.",
    }
    rows += [(f"odd-{k}", vi.format("Bùi Lan"), a, "bridge", "", "") for k, a in odd.items()]
    rows += [("odd-vi", en.format("Bùi Lan"), "Vì trận lụt năm 1800 nên họ phải nhường lại đất cho làng bên sông.", "bridge", "", ""), ("ok-name", vi.format("Bùi Lan") + " b", "Lê Lợi", "bridge", "", ""), ("ok-null", None, "The flood of 1800 came.", "bridge", "", "")]
    assert run(spark, rows) == {f"odd-{k}": "language" for k in (*odd, "vi")}


@pytest.mark.parametrize("refusal", ["Mi dispiace, ma a questa domanda non posso rispondere.", "Ik kan deze vraag helaas niet beantwoorden.", "Infelizmente eu prefiro não responder a isso."])
def test_refusals_of_any_language_recur_and_inform_of_nothing(spark, refusal):
    openings = ("Ai lập", "Vì sao có", "Khi nào sửa", "Ở đâu dựng", "Bao nhiêu người giữ")
    rows = [(f"no{i}", f"{openings[i % 5]} hội số {i} của làng bên sông theo trang cũ?", refusal, "bridge", "", "") for i in range(10)]
    rows += [(f"ok{i}", f"{openings[i % 5]} đình số {i} của làng bên sông theo trang cũ?", f"Ông Lê Văn {n} lập đình năm 18{i:02d}.", "bridge", "", "") for i, n in enumerate(("An", "Bình", "Cường", "Dũng", "Em", "Giang", "Hà", "Kha", "Lan", "Minh"))]
    assert run(spark, rows) == {f"no{i}": "refusal" for i in range(10)}


def test_openings_close_over_chains_and_past_the_most_frequent(spark):
    base = "toi khong duoc phep cung cap noi dung nay cho ban"
    near, chained = base + " a", base + " a x"
    other = "ong ay da roi lang ben song tu nam truoc do"
    got = dict(D.opening_clusters(spark.createDataFrame([(base, 9), (near, 3), (chained, 1), (other, 5), (other + " e", 2)], "opening string, prompts long")).collect())
    assert got[base] == got[near] == got[chained] != got[other] == got[other + " e"]


def test_openings_of_a_large_band_all_meet(spark):
    base = "the archive of the river council holds the second register by the lake "
    heads = [base + hashlib.sha256(str(i).encode()).hexdigest()[:20] for i in range(700)]
    # alike to the most frequent one, and to one that no frequent one is alike to; bands hold up to 443 openings
    middle, last = heads[30][:-10], base.rstrip()
    rows = [(x, 1000 if x == heads[30] else 100) for x in heads] + [(middle, 1), (last, 1)]
    got = dict(D.opening_clusters(spark.createDataFrame(rows, "opening string, prompts long")).collect())
    assert got[heads[30]] == got[middle] == got[last] and len(set(got.values())) == 700


def test_templates_reveal_refusals_and_cuts(spark):
    names = ["Lê Lợi", "Trần Phú", "Lý Bí", "Mai An", "Hồ Quý", "Vũ Tam", "Đỗ Tư", "Ngô Ba"]
    rows = []
    for i, n in enumerate(names * 8):
        q = f"Hỏi điều số {i} về ông {n} trong sổ làng bên sông cũ?"
        full = f"Ông {n} gắn với làng qua một văn khế lập năm 18{i:02d}, trong khi sổ kia chỉ nhắc lại."
        rows.append((f"ok{i}", q, full, "bridge", "", ""))
        rows.append((f"fact{i}", q + "?", f"Ông từ chối trả lời phỏng vấn của {n} và rời làng năm 19{i:02d}.", "bridge", "", ""))
        if i % 4 == 0:
            rows.append((f"no{i}", q + " nhé?", f"Tôi không được phép cung cấp nội dung về {n}.", "bridge", "", ""))
            rows.append((f"cut{i}", q + " ạ?", " ".join(full.split()[: 7 + i // 4 % 9]), "bridge", "", ""))
            rows.append((f"right{i}", q + " đi?", "Câu hỏi không trả lời được từ các trang đã cho.", "unanswerable", "", ""))
    rows += [("e", "Câu hỏi nào đó về sông?", None, "bridge", "", ""), ("e", "Câu hỏi nào đó về sông?", None, "bridge", "", ""), (None, "a", "b", None, "", ""), ("q0", None, "Năm 1852", None, "", ""), ("long", "Hỏi về sông?", "Ông kể lại. " * 3000, "bridge", "", "")]
    got = run(spark, rows)
    assert got.pop("e") == "empty"
    assert {k: v for k, v in got.items() if k[:2] == "no"} == {f"no{i}": "refusal" for i in range(0, 64, 4)}
    assert {k: v for k, v in got.items() if k[:3] == "cut"} == {f"cut{i}": "truncated" for i in range(0, 64, 4)}
    assert set(k.rstrip("0123456789") for k in got) == {"no", "cut"}


def test_no_rows(spark):
    assert run(spark, []) == {}
