from __future__ import annotations

import random
import time

import pytest

from codestrata.llm.sentences import Known, learned_abbreviations, sentence_spans, sentences


def split(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("parts", [
    ["Dr. Varnholt and Prof. Elmskog wrote it.", "It ran until 5 p.m.", "The rest is fine."],
    ["The job stops at 9 p.m. every Friday.", "Nothing came back…", "The scan waits… and then it is gone."],
    ["See No. 7 for more.", "No.", "Not yet!", "approx. 9 files were skipped."],
    ["We tried v2.9.4 vs. v0.4.1, i.e. both.", "Coverage fell from 50.40% to 68.95 %."],
    ['The hook printed "No such chunk. Did you mean `a.B`?" and stopped.', '"The glob is stale."', "Our index, cf. `writeIndex`, is old."],
    ["Call collect! before match? is asked.", "It failed again?!", "(Nothing was written.)", "J. R. Oxley-Thorne signed."],
    ["The label `outcome.` ends in a dot.", "Run `map --all ./...` once more."],
    ["Der 2. Versuch endete um 14.30 Uhr.", "Das gilt z. B. für uns, d. h. alle.", "„Der Index fehlt. Bitte neu laden.“ stand da.", "Es dauerte 3 ms.", "Version 1.2.3 fehlt."],
    ["Le journal dit « Rien à faire. Suivant ? » et s’arrête.", "M. Valbrune a relu.", "Est-ce vide ?"],
    ["La Sra. Olmedal revisó la pág. 7.", "El aviso decía «Falta uno. Otra vez.» y nada más.", "¿Existe?"],
    ["Файл пропущен, т. е. его не читали.", "См. рис. 4 в отчёте.", "Имена, поля и т. д. перед записью."],
    ["이 가지는 4.35 초가 필요하다.", "색인이 오래되었습니다."],
    ["यह शाखा 1.2 मिनट लेती है।", "सूची पुरानी है।"],
])
def test_spaced_scripts(parts):
    assert split(" ".join(parts)) == parts
    assert split("\n".join(parts)) == parts


@pytest.mark.parametrize("parts", [
    ["Gen. Smith met Sgt. Pepper in St. Louis on Oct. 5.", "They climbed Mt. Everest.", "See Vol. 3, ch. 4 and art. 12."],
    ["ខ្ញុំទៅផ្សារ។", "គាត់ទៅសាលា។"], ["ကျွန်တော်သွားသည်။", "သူလာသည်။"], ["ሰላም ነው።", "ደህና ነህ፧"], ["Is it?!", "It is‼"],
])
def test_more_abbreviations_and_scripts(parts):
    assert split(" ".join(parts)) == parts


def test_learned_abbreviations(spark):
    texts = [f"It took {k} zyk. in all and zyk. {k} more. The abk. Foo ran, abk. bar too. A plain end. Then more." for k in range(60)]
    texts += ["plain words and an end here", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    known = learned_abbreviations(df)
    assert known.never == {"zyk"} and known.maybe == {"abk"}
    assert [t[a:b] for t in texts[3:4] for a, b in sentence_spans("It took 3 zyk. Later abk. Then more.", known) for t in ["It took 3 zyk. Later abk. Then more."]] == ["It took 3 zyk. Later abk.", "Then more."]
    assert learned_abbreviations(df.limit(0)) == Known()


def test_many_quotations_are_not_quadratic():
    begin = time.process_time()
    sentence_spans('"a" b. ' * 20_000)
    assert time.process_time() - begin < 20


def test_scripts_without_spaces():
    parts = ["担当者は「終わった。」と書いた。", "「確認済みです。」", "次の枝は変わらない。", "版0.1.3では？", "はい！"]
    assert split("".join(parts)) == parts
    parts = ["日志写着“找不到名称。请重试。”然后停了。", "“retry”这一步没有了。"]
    assert split("".join(parts)) == parts


def test_thai_spaces_between_thai_characters_only():
    assert split("ดัชนีเก่า ใช้เวลา 0.70 วินาที  ไม่พบ\nชื่อ abc กิ่ง") == ["ดัชนีเก่า", "ใช้เวลา 0.70 วินาที", "ไม่พบ\nชื่อ abc กิ่ง"]


def test_layout():
    text = "## Heading\n\nA wrapped\nline here\n- item one. Second.\n* star\n12. third\n \t\nLast without stop \r\n\r\nEnd"
    assert split(text) == ["## Heading", "A wrapped\nline here", "- item one.", "Second.", "* star", "12. third", "Last without stop", "End"]


def test_blanks_before_a_list_mark():
    assert split(" \u00a01. The item. More.\n  - next") == ["1. The item.", "More.", "- next"]


def test_blank_null_and_odd_texts():
    assert [split(t) for t in (None, "", "  \n\t ", "...", "?", "“", "a")] == [[], [], [], ["..."], ["?"], ["“"], ["a"]]


def test_cover_everything_and_stay_quick_on_long_texts():
    rng = random.Random(9)
    for text in ("Go on. " * 40_000, "no stop at all " * 20_000, '"open quote. ' * 5_000, "".join(rng.choices('aB. "“”「」。!?\n-1()', k=30_000))):
        spans = sentence_spans(text)
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, " ", "x"), (1, "A b. C d.", "x")], "doc_id long, text string, seq string")
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences(df).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sentences(df.limit(0)).count() == 0
