"""Sentence units in many scripts."""

import random

import pytest

from loreweave.llm.sentences import sentence_spans, split_sentences

CASES = [
    ("It works! Dr. Brown reads No. 7 vs. No. 9 in a_b.py. See Fig. 3.", ["It works!", "Dr. Brown reads No. 7 vs. No. 9 in a_b.py.", "See Fig. 3."]),
    ("The run starts at 4 a.m. and ends at 5 p.m. Then it stops.", ["The run starts at 4 a.m. and ends at 5 p.m.", "Then it stops."]),
    ('"Can we pin 1.2?" asked C. D. Doe after the demo. It waits... and waits. It hung... Next.', ['"Can we pin 1.2?" asked C. D. Doe after the demo.', "It waits... and waits.", "It hung...", "Next."]),
    ('R. Roe wrote: "It failed. Nobody saw." Really?! (This holds. See b.) End', ['R. Roe wrote: "It failed. Nobody saw."', "Really?!", "(This holds. See b.)", "End"]),
    ("Am 3. Mai hat Dipl.-Ing. Roe die Datei geprüft. Das gilt z. B. für Nr. 7, d. h. weniger. Im 2. Quartal wird er ersetzt.", ["Am 3. Mai hat Dipl.-Ing. Roe die Datei geprüft.", "Das gilt z. B. für Nr. 7, d. h. weniger.", "Im 2. Quartal wird er ersetzt."]),
    ("M. Roe a écrit : « C'est tombé. Personne ne l'a vu. » Par ex. l'index. Vraiment ?! Oui.", ["M. Roe a écrit : « C'est tombé. Personne ne l'a vu. »", "Par ex. l'index.", "Vraiment ?!", "Oui."]),
    ("EE. UU. va con retraso. ¿De verdad?! El Sr. Roe no está.", ["EE. UU. va con retraso.", "¿De verdad?!", "El Sr. Roe no está."]),
    ("他说“停下来！”，接着走了。评审人写道：“失败了。没有人。”大约5个（参见a.md。）没有。真的吗？！一直等……直到放手。", ["他说“停下来！”，接着走了。", "评审人写道：“失败了。没有人。”", "大约5个（参见a.md。）没有。", "真的吗？！", "一直等……直到放手。"]),
    ("「はい。」と答えて閉じました。本当ですか？！約9件（Fを参照。）が残る。", ["「はい。」と答えて閉じました。", "本当ですか？！", "約9件（Fを参照。）が残る。"]),
    ('डॉ. वेलमोरा ने जाँच की। उसने लिखा: "काम रुका। नहीं देखा।" और कुछ नहीं।', ["डॉ. वेलमोरा ने जाँच की।", 'उसने लिखा: "काम रुका। नहीं देखा।"', "और कुछ नहीं।"]),
    ("راجع د. فلمورا الجدول. كتبت: «فشل. لم يلاحظ.» لماذا؟ لم يتغير شيء.", ["راجع د. فلمورا الجدول.", "كتبت: «فشل. لم يلاحظ.»", "لماذا؟", "لم يتغير شيء."]),
    ("ห้ามเปลี่ยนชื่อครับ ตั้งแต่รุ่น v1.2 คิวงานเขียน 9 แถว เหลืออีก 5 ไฟล์", ["ห้ามเปลี่ยนชื่อครับ", "ตั้งแต่รุ่น v1.2 คิวงานเขียน 9 แถว", "เหลืออีก 5 ไฟล์"]),
    ("# Head. Two ##\n\n- one. Two\n- three\n  goes on\n1. a\n2. b\n\npara on\ntwo lines. More\n\n```\ncode. Here\n```\nend", ["Head. Two", "one.", "Two", "three\n  goes on", "a", "b", "para on\ntwo lines.", "More", "end"]),
    ("It takes 5 s per page.Then it stops. Node.js and a.Java are one.So is e.g. this. Really?He asked.", ["It takes 5 s per page.", "Then it stops.", "Node.js and a.Java are one.", "So is e.g. this.", "Really?", "He asked."]),
    ("", []), (" \n\t\n", []), ("```\nopen fence. Never closed", []), ("...", ["..."]),
]


@pytest.mark.parametrize(("text", "units"), CASES)
def test_units(text, units):
    assert [text[a:b] for a, b in sentence_spans(text)] == units
    crlf = text.replace("\n", "\r\n")
    assert [crlf[a:b].replace("\r\n", "\n") for a, b in sentence_spans(crlf)] == units


@pytest.mark.parametrize(
    ("text", "lang", "units"),
    [
        ("The light is on. Turn it off.", "en", 2), ("That is what it depends on. The rest follows.", "en", 2), ("Set the env. Then run it.", None, 2), ("We rely on the rep. They agreed.", "it", 2), ("Il est. Ensuite il part.", "fr", 2),
        ("L'On. Rossi parla.", "it", 1), ("L'On. Rossi parla.", "Italiano", 1), ("Rep. Roe and Sen. Doe spoke. They left.", "en", 2), ("La voie est ouverte par le Dr. Roe. Elle part.", "fr", 2), ("Dr. Roe prüft das am 3. Mai. Es gilt.", None, 2), ("Seen 3. May.", "en", 2),
        ("ܐ܀ ܒ", None, 2), ("ꦲ꧉ ꦲ꧉", None, 2), ("ꯀ꯫ ꯀ", None, 2), ("ꨀ꩝ ꨀ", None, 2), ("Really‽ Yes﹒ No", "en", 3), ("Ընդ։ Այո", None, 2), ("X" * 300 + ". Then.", "en", 2), ("See " + "a" * 300 + ".Then it", "en", 1),
    ],
)
def test_language_and_properties(text, lang, units):
    assert len(sentence_spans(text, lang)) == units


@pytest.mark.parametrize("seed", range(40))
def test_any_text_gives_ordered_units(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(list("ab. AB!?\n\"'«»()“”。！、「」#-*1) \r\t`…ไ") + ["```\n", "\n\n", "Dr. "]) for _ in range(rng.randrange(400)))
    spans = sentence_spans(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_long_text_in_linear_time():
    assert len(sentence_spans("A short one. " * 60_000)) == 60_000
    assert len(sentence_spans("(" * 50_000 + "ok. Yes")) == 2
    assert sentence_spans("x" * 2_000_000) == [(0, 2_000_000)]


def test_frames(spark):
    df = spark.createDataFrame([(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 5), (None, "x", 5), (3, "", 5)], "doc_id bigint, text string, start_pos int")
    titled = spark.createDataFrame([(1, "L'On. Rossi.", "it"), (2, "L'On. Rossi.", "en"), (3, "L'On. Rossi.", None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r["count"] for r in split_sentences(titled).groupBy("doc_id").count().collect()} == {1: 1, 2: 2, 3: 2}
    assert sorted(set(map(tuple, split_sentences(df).collect()))) == [(1, 1, 0, 4, "One."), (1, 2, 5, 9, "Two.")]
    assert split_sentences(df.limit(0)).count() == 0
