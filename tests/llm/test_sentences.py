"""Sentence units of many languages and scripts."""

import pytest

from codeweft.llm.sentences import units

CASES = [
    ("Dr. Vellamo et al. agree. It works! Does it?", ["Dr. Vellamo et al. agree.", "It works!", "Does it?"]),
    ("We measured 57.60 ms on v7.14.1, i.e. 14.8% more. See https://x.example/a?b=1.c now.", ["We measured 57.60 ms on v7.14.1, i.e. 14.8% more.", "See https://x.example/a?b=1.c now."]),
    ('The reviewer wrote: "Stop here. This is not safe." and closed it. “Do not merge this.” "Who calls x?" asked one.', ['The reviewer wrote: "Stop here. This is not safe." and closed it.', "“Do not merge this.”", '"Who calls x?" asked one.']),
    ("It waits... until done. hardStage is set. a/b.c is next, etc. Tokens etc. are kept.", ["It waits... until done.", "hardStage is set.", "a/b.c is next, etc.", "Tokens etc. are kept."]),
    ("Landed on 5 Oct. 2023 at 10:23 p.m. in No. 3. Why does the U.S. tenant skip?! Yes.", ["Landed on 5 Oct. 2023 at 10:23 p.m. in No. 3.", "Why does the U.S. tenant skip?!", "Yes."]),
    ("Das betrifft z. B. a/b.c, d. h. Zeile 2. Bis zum 12. Juli gilt Nr. 5 (s. CWE-1). „Halt. Nein.“ rief er. Namen usw. Ende.", ["Das betrifft z. B. a/b.c, d. h. Zeile 2.", "Bis zum 12. Juli gilt Nr. 5 (s. CWE-1).", "„Halt. Nein.“ rief er.", "Namen usw.", "Ende."]),
    ("« Qui appelle x ? » demande Mme Corvelle. M. Tavernoux a écrit : « Stop. Non. » et part ! Fin.", ["« Qui appelle x ? » demande Mme Corvelle.", "M. Tavernoux a écrit : « Stop. Non. » et part !", "Fin."]),
    ("En EE. UU. la regla vale. El Sr. Olmedal dijo: «Basta. No.» y salió. ¿Se escapa x? ¡Sí!", ["En EE. UU. la regla vale.", "El Sr. Olmedal dijo: «Basta. No.» y salió.", "¿Se escapa x?", "¡Sí!"]),
    ("Это т. е. так. Ключи и т. д. Правило с 16 мая 2024 г. для всех. См. a/b.c, стр. 3.", ["Это т. е. так.", "Ключи и т. д.", "Правило с 16 мая 2024 г. для всех.", "См. a/b.c, стр. 3."]),
    ("深刻度は「高」です。「止めて。安全です。」と書いた。平均5.1秒でした！はい？", ["深刻度は「高」です。", "「止めて。安全です。」と書いた。", "平均5.1秒でした！", "はい？"]),
    ("审查者写道：“停下。不安全。”然后关闭。真的吗？！名称等等……但没有密码。", ["审查者写道：“停下。不安全。”然后关闭。", "真的吗？！", "名称等等……但没有密码。"]),
    ("रुकिए। डॉ. वेलामो ने मि.से. लिखा। \"हाँ। नहीं।\" और बंद। ठीक?", ["रुकिए।", "डॉ. वेलामो ने मि.से. लिखा।", '"हाँ। नहीं।" और बंद।', "ठीक?"]),
    ("هل هذا آمن؟ كتب: «توقف. لا.» ثم أغلق. نعم!", ["هل هذا آمن؟", "كتب: «توقف. لا.» ثم أغلق.", "نعم!"]),
    ("รุ่น0.7.0ใช้เวลา5.4มิลลิวินาที ควรแก้ไขก่อน", ["รุ่น0.7.0ใช้เวลา5.4มิลลิวินาที", "ควรแก้ไขก่อน"]),
    ('검토자는 "멈추세요. 안됩니다."라고 적었습니다. 끝.', ['검토자는 "멈추세요. 안됩니다."라고 적었습니다.', "끝."]),
    ("# Why? Because. So\n\nOne line\nbroken here. Two\n\nno end", ["# Why? Because. So", "One line\nbroken here.", "Two", "no end"]),
    ("- a. B c. D\n- e\n\n1. One. Two\n2. Three\n\nText\r\nmore.\r\n\r\n> Quoted. Text.", ["- a. B c. D", "- e", "1. One. Two", "2. Three", "Text\r\nmore.", "> Quoted.", "Text."]),
    ("Before.\n\n```python\nx = 1. Y\n\n# Z. W\n```\n\nAfter. End", ["Before.", "```python\nx = 1. Y\n\n# Z. W\n```", "After.", "End"]),
    ("```\nnever. Closed\n\nx", ["```\nnever. Closed\n\nx"]),
    ('He wrote: "' + "No. Stop here. " * 60 + 'End." and left. Then he came.', ['He wrote: "' + "No. Stop here. " * 60 + 'End." and left.', "Then he came."]),
    ("Sie sagte: „" + "Nein. Halt. " * 80 + "Gut.“ und ging. Dann kam er.", ["Sie sagte: „" + "Nein. Halt. " * 80 + "Gut.“ und ging.", "Dann kam er."]),
    ("1. One" + " and more" * 120 + ". Yes\n2. Two. Three\nText", ["1. One" + " and more" * 120 + ". Yes", "2. Two. Three", "Text"]),
    ("", []), ("  \n\t\n ", []), (None, []),
]


@pytest.fixture(scope="module")
def got(spark):
    d = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string, k string, row int")
    out = {}
    for r in units(d).collect():
        out.setdefault(r.doc_id, []).append((r.sent_no, r.end_pos, r.sentence))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_units(got, i):
    text, want = CASES[i]
    have = got.get(i, [])
    assert [s for _, _, s in have] == want
    assert [n for n, _, _ in have] == list(range(len(want)))
    for _, end, s in have:
        assert text[:end].endswith(s)


def test_odd_rows(spark):
    one = "Ein Satz. " * 3000
    d = spark.createDataFrame([(1, one), (1, "A. B\U000F0000C. D"), (None, "X. Y")], "doc_id bigint, text string")
    rows = units(d).collect()
    assert sum(r.sentence == "Ein Satz." for r in rows) == 3000
    assert max(r.end_pos for r in rows) == len(one.rstrip())
    assert {r.sentence for r in rows if r.doc_id is None} == {"X.", "Y"}
    assert units(d.limit(0)).count() == 0


def test_own_private_characters_come_back(spark):
    own = "".join(chr(c) for c in (0xF0000, 0xF0010, 0xF0030, 0xF0033))
    texts = {1: f"Icon {own} here. And {own[0]} there.", 2: f"# {own}\n\n- x{own[1]}. y\n", 3: "Plain. Text."}
    rows = sorted(units(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect())
    assert [(r.doc_id, r.sentence) for r in rows] == [(1, f"Icon {own} here."), (1, f"And {own[0]} there."), (2, f"# {own}"), (2, f"- x{own[1]}. y"), (3, "Plain."), (3, "Text.")]
    assert all(texts[r.doc_id][: r.end_pos].endswith(r.sentence) for r in rows)


def test_many_units_in_one_text(spark):
    text = "".join(f"Number {i} is here. " if i % 7 else f"It ends {i}.\n\n" for i in range(5000))
    rows = units(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("sent_no").collect()
    assert [r.sent_no for r in rows] == list(range(5000)) and all(text[r.end_pos - len(r.sentence) : r.end_pos] == r.sentence for r in rows)
    assert "Exchange" not in units(spark.createDataFrame([(1, text)], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
