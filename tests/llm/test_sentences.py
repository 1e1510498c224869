import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import sentences as S

# Each case is a list of units; they are joined as they stand.
CASES = [
    ["We use Fig. 3 and Eq. (4). ", "Dr. J. R. Smith et al. agree, e.g. with No. 5. ", "It rose from 0.1 to .25 vs. 3.4 before."],
    ["See Fig. 10. ", "Overall, it works (Moular et al.). ", "(Details are in Sec. 3.1.) ", "Next one!"],
    ["“Is it stable?” ", "Moreover, one asked \"Who says so?\" before lunch. ", "“It fails,” she notes, “yet it runs.” ", "Human ratings."],
    ["Related work\n\n", "- First item of a list.\n", "(a) Second item, i.e. the last.\n", "3.2 Setup\n", "A. editor details\n", "Text"],
    ["Not quite ... ", "Overall, Brapiox 2.0 ... and the rest hold. ", "eName systems too."],
    ["The end of routing.", "Human ratings say so.", "At data.host.example/v1.2 it stays."],
    ["Laut Nr. 15 gilt, d. h. am 3. Tag z. B. die Wahl bzw. mehr. ", "„Die Note misst“, schreibt Prof. Abt, „aber nicht ein.“ ", "Nein. ", "Der Rest."],
    ["Voir No. 5. ", "Est-ce suffisant ? ", "« Le bruit isole », écrit M. abt, « mais avec lui. » ", "Le reste."],
    ["¿Es suficiente? ", "No lo es. ", "¡Qué diferencia! ", "Según la Dra. Ruiz, p. ej. el resto."],
    ["他们提出了方法。", "“查询连接了标题，”他写道，“但是失败了。”", "结果为2.0分！", "这够吗？"],
    ["「評価は短い。」とabcは述べ、分割した。", "しかし、Abc 2.0では15.2点だ！", "なぜ？"],
    ["เราพบว่าดัชนีดี ", "ยังไม่พอ ", "เหตุใดตัวกรองของDaxNetจึงวัดคำประสม"],
    ["क्या यह पर्याप्त है? ", "नहीं। ", "डॉ. abc का प्रश्न है।", "फिर।"],
    ["«المصنف يستبدل» كما كتب د. abc «لكن المدخل يعزل». ", "ليس كذلك. ", "هل هذا كاف؟ ", "نعم."],
]


@pytest.mark.parametrize("units", CASES, ids=range(len(CASES)))
def test_languages(units):
    text = "".join(units)
    assert [text[a:b] for a, b in S.spans(text)] == [u.strip() for u in units]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aB1. !?\n\"'“”«»()。」「 กข中।…-", max_size=60))
def test_all_text_belongs_to_one_unit(text):
    found = S.spans(text)
    at = 0
    for a, b in found:
        assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_lattice_prefers_dictionary_words():
    lattices = S.PLAIN.lattices
    assert lattices["ja"].segment("としかし") == ["と", "しかし"]
    assert lattices["th"].segment("นอกจากนี้xyz")[0] == "นอกจากนี้"
    assert lattices["zh"].segment("") == []
    learned = S.Lattice(["ที่"], {"พื้นที่": 30})
    assert learned.segment("xพื้นที่") == ["x", "พื้นที่"] and S.Lattice(["ที่"]).segment("xพื้นที่")[-1] == "ที่"


# Held-out sentences: none has an opening of the test tables.
SPACELESS = [
    ["ฉันไปตลาด ", "วันนี้อากาศดี"],
    ["เขาซื้อผักและผลไม้ และขนมหวาน ", "ต่อมาเขากลับบ้าน"],
    ["แม่กล่าวว่า ลูกต้องนอน ", "ทำไมลูกไม่นอนคะ ", "คุณพ่อหลับแล้ว"],
    ["明日は雨です。", "傘を持って行きますか？", "ところで、猫はどこだ…", "しかし犬はいる。"],
    ["「もう遅い！」と母は言った。", "「帰ろう。」", "父は笑った。"],
    ["今日は寒いです また雪が降ります"],
    ["行くぞ！と叫んで走った。", "誰も来ない。"],
    ["天气很好。", "“我们走吧！”他说。", "“好。”", "大家都笑了……", "不过雨来了。"],
    ["他说：“明天见。”的时候门开了。", "于是我走了。"],
]


@pytest.mark.parametrize("units", SPACELESS, ids=range(len(SPACELESS)))
def test_spaceless_scripts(units):
    text = "".join(units)
    found = [text[a:b] for a, b in S.spans(text)]
    if units[0].startswith("今日は"):
        assert found == ["今日は寒いです", "また雪が降ります"]
    else:
        assert found == [u.strip() for u in units]


def test_words_of_the_collection_are_told_from_particles(spark):
    texts = ["ในพื้นที่ ABC มีคน", "พื้นที่", "เขาพบพื้นที่", "พื้นที่กว้าง", "ของพื้นที่", "และพื้นที่"] * 3
    learned = S.dictionary(spark.createDataFrame([(t,) for t in texts] + [("猫が好き。猫は好き。",)] * 5 + [("短查询的结果",)] * 5, "text string"))
    assert "พื้นที่" in learned["th"] and "好き" in learned["ja"] and learned["zh"]["结果"] == 5 and "短查询的" not in learned["zh"]
    gaps, text = S.Gaps(learned), "เราอยู่ในพื้นที่ เขากลับบ้าน"
    assert len(S.spans(text, gaps)) == 2 and len(S.spans(text)) == 1
    assert S.dictionary(spark.createDataFrame([(None,), ("",), ("plain",)], "text string")) == {"th": {}, "ja": {}, "zh": {}}


LINES = ["a.b,a.b,", "A. B. ", "word ", "1.", "\"", "(", "(.)", "...", ". ", "x. A", "1. A ", "\".", "e.g. ", "/x.Y", "。", "ที่ ", "「。」", "' ", "(\"", "A", " ", "です ", "“„", "U.S.A.-"]


@pytest.mark.parametrize("piece", LINES, ids=range(len(LINES)))
def test_time_is_in_proportion_to_a_line(piece):
    import time

    def seconds(n):
        text = piece * (n // len(piece))
        began = time.process_time()
        S.spans(text)
        return time.process_time() - began

    seconds(1000)
    small, large = min(seconds(50_000) for _ in range(3)), min(seconds(400_000) for _ in range(2))
    assert large < 20 * small + 0.1


def test_tables(spark):
    schema = "id string, {} string, item_id string"
    chunks = spark.createDataFrame([("c", "One. Two", "x"), ("c", "One. Two", "x"), ("n", None, "x"), ("e", "", "x"), ("b", " \n\t", "x"), (None, "A.", "x"), ("l", "Word one. " * 5000, "x")], schema.format("text"))
    claims = spark.createDataFrame([("k", "  Only this.  ", "x")], schema.format("verbatim"))
    rows = [tuple(r) for r in S.sentences(chunks, claims).collect()]
    assert {r for r in rows if r[1] != "l"} == {("chunk", "c", 0, 4), ("chunk", "c", 5, 8), ("claim", "k", 2, 12)} and len(rows) == 5003
    assert S.sentences(chunks.limit(0), claims.limit(0)).count() == 0
