from __future__ import annotations

import unicodedata
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import answers, dates, enrich, language, text, urls
from siftline.functions.language import Concept, Lexicons

CASES = ["الجَزَائِر ٢٠٢٦", "ﻻ ﷲ", "Ａｂｃ １２３", "a​b­c", "  x\t\ny\x0bz ", "كـــتاب", "İSTANBUL", "ß ﬁ", "", "\x00\x07ab", "café"]


def column(spark, values, f):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in frame.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_normalize_as_its_rules(spark):
    assert column(spark, CASES, text.normalize) == [language.normal(c) for c in CASES]
    assert column(spark, ["الجَزَائِر ٢٠٢٦"], text.normalize) == ["الجزائر 2026"]


def test_whole_texts_are_normalised(spark, tmp_path):
    from siftline import catalog

    head = "ab " * 70_000
    for one, two in ((head + "xx", head + "yy and the end"), (head + "é xx", head + "é yy and the end")):
        assert column(spark, [one, two], text.normalize) == [one, two] == [language.normal(one), language.normal(two)]
        assert column(spark, [one], lambda c: text.normalize(c, text.MOST_CHARS)) == [one[: text.MOST_CHARS].rstrip()] == [language.normal(one, text.MOST_CHARS)]
        assert len({*column(spark, [one, two], text.content_hash)}) == 2
        assert column(spark, [one, two], lambda c: F.size(text.tokens(text.fold(c)))) == [len(one.split()), len(two.split())]
        assert column(spark, [two], text.fold_plain)[0].endswith("the end")
    rows = [(1, head + "xx", "en", "src1", 210_002), (2, head + "the", "en", "src1", 210_003)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in catalog.queries()["search_exclusion"](spark, str(tmp_path)).collect()] == [1]


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_normal_is_idempotent_and_fold_refines_it(s):
    once = language.normal(s)
    assert language.normal(once) == once
    assert language.folded(language.normal(s)) == language.folded(s)
    assert not any(unicodedata.category(c) == "Cc" for c in once)


def test_ascii_takes_the_same_way(spark):
    plain = ["A  b\tC", "x\x0by", "\x01\x02q"]
    assert column(spark, plain, text.normalize) == column(spark, plain, text.normalize_plain)


def test_fold_script_and_hashes(spark):
    assert column(spark, ["أحمد إلى مدرسة", "ؤ ئ ك"], text.fold) == ["احمد الي مدرسه", "و ي ك"]
    assert column(spark, ["hello", "سلام", "hello سلام", "123", "привет"], text.script) == ["latin", "arabic", "mixed", "unknown", "unknown"]
    words = " ".join(f"w{k}" for k in range(30))
    one, two, short = column(spark, [words, words + " w30", "too few"], text.simhash)
    assert short is None and bin((one ^ two) & 0xFFFFFFFFFFFFFFFF).count("1") < 20
    assert one == text.simhash_of(words)
    assert column(spark, [words], lambda c: text.hash_hex(text.simhash(c)))[0] == f"{one & 0xFFFFFFFFFFFFFFFF:016x}"


def test_excerpt_title_highlight_tags(spark):
    long = "A sentence here. " * 30
    assert column(spark, [long], text.excerpt)[0].endswith("here.")
    assert column(spark, ["x" * 400], text.excerpt)[0] == "x" * 320 + "…"
    assert column(spark, ["News - Site | Home"], text.trim_title) == ["News"]
    assert column(spark, ["The end of them"], lambda c: text.highlight(c, ["the", "end"])) == ["<em>The</em> <em>end</em> of them"]
    assert column(spark, ["<p>a &amp; <b>b</b></p>"], text.strip_tags) == ["a & b"]


def test_urls(spark):
    assert [urls.canonical_url(u) for u in ("http://A.com/x/?utm_source=a&b=2&a=1#t", "https://a.com/", "nothing", None)] == ["http://a.com/x?a=1&b=2", "https://a.com", None, None]
    assert [urls.unsafe_reason(u) for u in ("http://127.0.0.1/", "http://[::1]/", "http://2130706433/", "http://a.com:22/", "http://u:p@a.com/", "file:///etc", "http://8.8.8.8/")] == ["private_address"] * 3 + ["port", "credentials", "scheme", None]
    assert column(spark, ["http://www.A.com/x", "bad url"], urls.domain_of) == ["a.com", None]
    assert column(spark, ["http://a/" + "x/" * 13, "http://a/?" + "&".join(f"p{k}=1" for k in range(9)), "http://a/b/b/b/b", "http://a/?PHPSESSID=1", "http://a/ok"], urls.trap) == ["too_deep", "too_many_parameters", "repeated_segment", "session_id", None]
    assert column(spark, ["http://www.a.com/news/some_long-title%20here/x"], urls.display_url) == ["a.com › news › some long title here"]


@pytest.mark.parametrize(
    ("written", "want"),
    [
        ("2024-05-06", (1714953600, "day")), ("2024-05-06T10:00:00Z", (1714989600, "second")), ("2024-05-06T10:00", (1714986000, "second")), ("2024-05-06T10:00:00+02:00", (1714982400, "second")),
        ("منذ 3 أيام", (1749740800, "day")), ("il y a 2 heures", (1749992800, "day")), ("12 janvier 2024", (1705017600, "day")), ("March 2023", (1677628800, "month")), ("١٢ جانفي", None),
        ("05/06/2024", (1717545600, "day")), ("25.12.2023", (1703462400, "day")), ("12/25/2023", (1703462400, "day")), ("1980-01-01", None), ("2030-01-01", None), ("junk", None), ("", None), (None, None),
    ],
)
def test_dates(written, want):
    assert dates.parse_date(written, 1_750_000_000) == want


def test_calendar(spark):
    frame = spark.createDataFrame([(date(2024, 7, 8),), (date(2000, 1, 1),)], "d date").select(dates.hijri(F.col("d")).alias("h"))
    assert [tuple(r.h) for r in frame.collect()] == [(1446, 1, 1), (1420, 9, 24)]
    assert column(spark, ["2024-05-06T01:02:03Z", "2024-05", "2024", "x"], dates.w3c_date) == [1714957323, 1714521600, 1704067200, None]


def test_detection():
    lex = Lexicons(darija={"بزاف": 1.0, "واش": 1.0}, arabizi={"wach": 1.0, "bzaf": 1.0}, french={"le": 0.5, "la": 0.5, "est": 0.5, "dans": 1.0}, english={"the": 0.5, "of": 0.5, "and": 0.5})
    assert language.detect_one("واش راك بزاف", lex)["language"] == "ary"
    assert language.detect_one("الكتاب على الطاولة", lex) == {"language": "ar", "confidence": 0.65, "script": "arabic", "secondary": None}
    assert language.detect_one("wach rak bzaf", lex)["language"] == "ary"
    assert language.detect_one("la maison est dans le jardin", lex)["language"] == "fr"
    assert language.detect_one("the end of the world and more", lex)["language"] == "en"
    assert language.detect_one("", lex)["language"] == "und"
    profiles = {"en": language.profile(["the cat sat on the mat with the other"]), "de": language.profile(["der hund und die katze mit dem ball"])}
    assert language.detect_one("the other cat sat with the mat", Lexicons(profiles=profiles))["language"] == "en"


def test_transliteration_and_expansion():
    assert language.to_arabic("kifach")[0][0].startswith("كيفا")
    assert len(language.to_arabic("bghit nsafer")) <= 4
    assert language.to_arabizi("شكرا") == "chkra"
    found = language.expand("voiture rouge", "fr", [Concept(("voiture", "auto", "سيارة"), 0.9)])
    assert found == [("voiture", "auto", 0.9), ("voiture", "سياره", 0.9)]


def test_questions(spark):
    asked = ["what is this", "كيف الحال", "kifach ndir", "ok?", "who", "it is you", "is it you", "plain words", ""]
    assert column(spark, asked, language.is_question) == [True, True, True, True, False, False, True, False, False]


def test_sentiment():
    valence = {"good": 3.0, "bad": -3.0, "great": 4.0, "كتاب": 2.0}
    one = lambda s: language.sentiment_one(s, valence)
    assert one("good")["label"] == "positive" and one("bad bad")["label"] == "negative"
    assert one("not great")["score"] < 0 < one("very good")["score"]
    assert one("")["label"] == "neutral" and one("goood great")["label"] == "positive"


def test_signals(spark):
    words = lambda c: F.split(c, " ")
    assert column(spark, ["match equipe football", "loi", "budget dinar match equipe"], lambda c: F.array_join(enrich.topics(words(c)), ",")) == ["sport", "", "economy,sport"]
    assert column(spark, ["oran oran alger", "oran alger", "tizi ouzou", "x"], lambda c: enrich.region(words(c))["code"]) == [31, None, 15, None]
    assert column(spark, ["casino en ligne ici", "rien"], lambda c: F.round(enrich.spam_score(words(c), ["casino en ligne"]), 4)) == [0.3333, 0.0]
    assert column(spark, ["spam " * 30 + "autre mot"], lambda c: enrich.spam_score(words(c), [])) == [1.0]


@pytest.mark.parametrize(
    ("query", "value"),
    [("2+3*4", "14"), ("200 + 10%", "220"), ("2^10", "1024"), ("sqrt(16)", "4"), ("1/0", None), ("2^100", None), ("٢+٣", "5"), ("12 km in mi", "7.456454 mi"), ("100 c in f", "212 f"), ("roman 1994", "MCMXCIV"), ("wilaya 16", "16 Alger"), ("2024-01-01 2024-03-01", "60 days"), ("rgb #ff8000", "255, 128, 0"), ("hello", None), ("", None), (None, None), ("loan 1000 0 1", "83.33"), ("vat 100", "119"), ("bmi 70 175", "22.9")],
)
def test_answers(query, value):
    found = answers.answer(query)
    assert (found.value if found else None) == value


def test_answers_are_isolated(monkeypatch):
    monkeypatch.setitem(answers.TOOLS, "date", lambda q, c: 1 / 0)
    assert answers.answer("1+1").value == "2"
    assert answers.answer("!calc 7").value if answers.answer("!calc 7") else True


def test_prayer_times_are_in_order():
    times = list(answers.prayer_times(date(2024, 6, 21), 36.75, 3.06).values())
    assert times == sorted(times) and times[2] == "12:49"


def test_summaries():
    assert answers.summary_faults("See a@b.cd [3]", 2) == ["contact", "unknown_passage"]
    assert answers.shorten("One. Two. Three. Four. Five.") == "One. Two. Three. Four."
    assert "needle" in answers.passage("x " * 300 + "needle " + "y " * 300, ["needle"])
    assert answers.asks_translation("traduire bonjour en anglais") == "en"
