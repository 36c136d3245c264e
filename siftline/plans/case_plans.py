"""Plans over small tables of hand-made cases, for what no generated table holds: Arabic, Darija, Arabizi and French, dates, unsafe URLs,
robots rules, questions to tools. Their SQL states the results that the rules give, or computes them from stated parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import answers, dates, language, text, urls
from siftline.functions.arrow import arrow
from siftline.plans.base import NOW, Query
from siftline.sources import robots

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plan(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def stated(columns: str, rows: list[tuple]) -> str:
    """SQL of a table with typed columns, `name TYPE, ...`."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = [c.split()[1] for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types)) + f" FROM (VALUES {values}) AS v({', '.join(names)})"


def _asked(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


LEXICONS = language.Lexicons(
    darija={"راني": 1.0, "بزاف": 1.0, "واش": 0.5},
    arabizi={"rani": 1.0, "labas": 1.0, "chwiya": 0.5},
    french={"bonjour": 1.0, "le": 0.5, "la": 0.5},
    english={"the": 0.5, "is": 0.5, "house": 1.0},
)
#: Texts with the language, confidence, script and second language that the rules give: .6 and shares of weight, coverage and digits.
DETECTED = [
    ("واش راك بزاف", "ary", 0.88, "arabic", None),  # weight 1.5: .18, coverage 2/3: at most .1
    ("هذا كتاب جديد", "ar", 0.65, "arabic", None),
    ("بزاف بزاف labas", "ary", 0.94, "arabic", None),  # 8 of 13 letters; weight 2: .24
    ("rani chwiya 3yan", "ary", 0.85, "latin", None),  # weight 1.5: .15, a digit for a letter: .1
    ("bonjour le monde", "fr", 0.72, "latin", None),
    ("rani f la maison le soir", "fr", 0.68, "latin", "ary"),  # two French hits against one
    ("the house is big", "en", 0.76, "latin", None),
    ("zzz qqq", "und", 0.0, "latin", None),
    ("واش راك labas hhh", "mixed", 0.6, "mixed", None),
    ("راني هنا bonjour x y", "ary", 0.75, "mixed", None),  # one French word of five is not .30
    ("راني هنا bonjour", "mixed", 0.7, "mixed", None),
    ("12 34", "und", 0.0, "unknown", None),
    ("", "und", 0.0, "unknown", None),
    (None, "und", 0.0, "unknown", None),
]


@plan
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in DETECTED]).withColumn("d", language.detect(LEXICONS)(F.col("text")))
    return rows.select("id", "d.language", F.round("d.confidence", 6).alias("confidence"), "d.script", "d.secondary")


SQL["lang_detect"] = stated("id INTEGER, language VARCHAR, confidence DOUBLE, script VARCHAR, secondary VARCHAR", [(k, *r[1:]) for k, r in enumerate(DETECTED)])

VALENCES = {"good": 2.0, "great": 3.0, "bad": -2.0, "awful": -3.0, "okay": 0.0, "مليح": 2.0, "فساد": -2.5}
#: Texts with the sum of valences after modifiers, emoji and marks, the hits, and the words.
FELT = [
    ("good", 2.0, 1, 1), ("not good", 2.0 * -0.74, 1, 2), ("very good", 2.0 * 1.3, 1, 2), ("slightly bad", -2.0 * 0.7, 1, 2), ("not very good", 2.0 * 1.3 * -0.74, 1, 3),
    ("good!!", 0.0, 0, 1), ("good !!!", 2.0 * 1.15, 1, 2), ("وفساد كبير", -2.5, 1, 2), ("goood", 0.0, 0, 1), ("😍", 3.2, 1, 1), ("great good bad awful", 0.0, 4, 4), ("machi مليح", 2.0 * -0.74, 1, 2),
    ("okay", 0.0, 1, 1), ("bad one two three four five six seven", -2.0, 1, 8), ("great one two three great one two three", 6.0, 2, 8), ("BAD ؟؟؟", -2.0 * 1.1, 1, 2), ("", 0.0, 0, 0), (None, 0.0, 0, 0),
    ("not a b c good", 2.0, 1, 5), ("بالمليح 👎", 2.0 - 2.4, 2, 2),
]


@plan
def lang_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in FELT]).withColumn("s", language.sentiment(VALENCES)(F.col("text")))
    return rows.select("id", "s.label", "s.score", "s.confidence")


SQL["lang_sentiment"] = f"""
WITH f AS ({stated("id INTEGER, total DOUBLE, hits DOUBLE, words DOUBLE", [(k, *r[1:]) for k, r in enumerate(FELT)])}),
s AS (SELECT id, total / sqrt(total * total + 15) AS score, CASE WHEN words = 0 THEN 0 ELSE least(1, greatest(hits / 4, hits / words)) END AS evidence FROM f),
c AS (SELECT id, score, evidence * (0.3 + 0.7 * least(1, 3 * abs(score))) AS confidence FROM s)
SELECT id, CASE WHEN confidence < 0.35 THEN 'neutral' WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label,
       round(CASE WHEN confidence < 0.35 THEN 0 ELSE score END, 6) AS score, round(confidence, 6) AS confidence FROM c"""

#: Latin tokens with their Arabic spellings, best first, and the best one's score: .3 or .2 for a first letter, .2 for others, .15 for a vowel
#: that is not written, .4 more after an alef that begins an article, .3 less for two long vowels.
SPELT = [
    ("ana", "انا|ان|نا|ن", 0.7), ("bb", "", None), ("a", "", None), ("bbb", "ب", 0.2), ("cch", "ش", 0.2), ("333", "", None), ("7ab", "حاب|حب", 0.6), ("sh3", "شع", 0.4), ("ouii", "وي", 0.1),
    ("aal", "ال", 0.9), ("SHH", "ش", 0.2), (None, "", None), ("", "", None),
]


@plan
def lang_to_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in SPELT]).withColumn("s", language.arabic_spellings(F.col("text")))
    return rows.select("id", F.array_join(F.col("s.text"), "|").alias("spellings"), F.round(F.get("s", F.lit(0))["score"], 6).alias("score"))


SQL["lang_to_arabic"] = stated("id INTEGER, spellings VARCHAR, score DOUBLE", [(k, *r[1:]) for k, r in enumerate(SPELT)])


@arrow("string")
def _latin(x):
    return x.map(lambda t: None if t is None else language.to_arabizi(t))


ARABIZI = [("شكرا", "chkra"), ("خبز", "khbz"), ("عين", "3in"), ("قوة", "9oua"), ("ok 5", "ok5"), ("ها!", "ha"), ("", ""), (None, None)]


@plan
def lang_to_arabizi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, [r[0] for r in ARABIZI]).select("id", _latin(F.col("text")).alias("latin"))


SQL["lang_to_arabizi"] = stated("id INTEGER, latin VARCHAR", [(k, r[1]) for k, r in enumerate(ARABIZI)])

CONCEPTS = [language.Concept(("voiture", "auto", "سيارة"), 0.9), language.Concept(("maison", "دار"), 0.99), language.Concept(("route", "chemin", "voie", "طريق"))]
#: Queries and languages with the words that are added: from concepts at most .95, spellings at .6, none for French.
EXPANDED = [
    ("voiture rouge", "fr", [("voiture", "auto", 0.9), ("voiture", "سياره", 0.9)]),
    ("auto voiture", "fr", [("auto", "سياره", 0.9), ("voiture", "سياره", 0.9)]),
    ("maison route la", "en", [("maison", "دار", 0.95), ("route", "chemin", 0.85), ("route", "voie", 0.85), ("route", "طريق", 0.85)]),
    ("bbb", "ary", [("bbb", "ب", 0.6)]),
    ("bbb cch sh3 7ab", "ary", [("bbb", "ب", 0.6), ("cch", "ش", 0.6), ("sh3", "شع", 0.6)]),
    ("la", "ary", []),
    ("", "fr", []),
]


@plan
def lang_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<struct<token:string,variant:string,weight:double>>")
    def expanded(q, lang):
        return q.combine(lang, lambda a, b: [dict(zip(("token", "variant", "weight"), x)) for x in language.expand(a, b, CONCEPTS)])

    rows = spark.createDataFrame([(k, q, c) for k, (q, c, _) in enumerate(EXPANDED)], "id int, text string, lang string")
    return rows.select("id", F.posexplode(expanded("text", "lang")).alias("place", "x")).select("id", "place", "x.token", "x.variant", F.round("x.weight", 6).alias("weight"))


SQL["lang_expand"] = stated("id INTEGER, place INTEGER, token VARCHAR, variant VARCHAR, weight DOUBLE", [(k, n, *x) for k, (_, _, found) in enumerate(EXPANDED) for n, x in enumerate(found)])

QUESTIONS = [
    ("what is this", True), ("كيف الحال", True), ("kifach ndir", True), ("ok?", True), ("هل تعرف", True), ("who", False), ("it is you", False), ("is it you", True), ("plain words", False), ("", False),
    ("où est la gare", True), ("c'est quoi ça", True), ("ماشي مشكل", False), ("shops and comment", True), ("ok؟", True), ("the who", False), (None, False),
]


@plan
def lang_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, [r[0] for r in QUESTIONS]).select("id", language.is_question(F.coalesce("text", F.lit(""))).alias("question"))


SQL["lang_questions"] = stated("id INTEGER, question BOOLEAN", [(k, r[1]) for k, r in enumerate(QUESTIONS)])

#: Texts with tatweel, marks, digits, capitals and letters, and what is left under six settings of the switches.
SWITCHES = [text.Switches(), text.Switches(diacritics=False), text.Switches(tatweel=False), text.Switches(digits=False), text.Switches(lowercase=False), text.Switches(letters=True), text.Switches(most=4)]
SWITCHED = [
    ("مـَلـيح ٣ Ab", ("مليح 3 ab", "مَليح 3 ab", "مـلـيح 3 ab", "مليح ٣ ab", "مليح 3 Ab", "مليح 3 ab", "مليح")),
    ("أحمَد  خدمة", ("أحمد خدمة", "أحمَد خدمة", "أحمد خدمة", "أحمد خدمة", "أحمد خدمة", "احمد خدمه", "أحمد")),
    ("ﬀ Ａ١", ("ff a1", "ff a1", "ff a1", "ff a١", "ff A1", "ff a1", "ff a")),
    ("", ("",) * 7),
]


@plan
def text_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in SWITCHED])
    return rows.select("id", *[text.normalize_with(F.col("text"), s).alias(f"s{k}") for k, s in enumerate(SWITCHES)])


SQL["text_switches"] = stated("id INTEGER, " + ", ".join(f"s{k} VARCHAR" for k in range(7)), [(k, *r[1]) for k, r in enumerate(SWITCHED)])

SCRIPTS = [("مرحبا", "arabic", 5, 0), ("hello", "latin", 0, 5), ("مرحبا hello", "mixed", 5, 5), ("ⵣⵣ", "unknown", 0, 0), ("12", "unknown", 0, 0), ("سلام ab", "arabic", 4, 2), ("été à", "latin", 0, 4)]


@plan
def text_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _asked(spark, [r[0] for r in SCRIPTS]).withColumns({"n": text.script_counts(F.col("text")), "script": text.script(F.col("text"))})
    return d.select("id", "script", F.col("n.arabic").cast("int").alias("arabic"), F.col("n.latin").cast("int").alias("latin"))


SQL["text_scripts"] = stated("id INTEGER, script VARCHAR, arabic INTEGER, latin INTEGER", [(k, *r[1:]) for k, r in enumerate(SCRIPTS)])

#: Dates in words and figures; the moments are stated in SQL. NOW is 14 November 2023, 22:13:20 UTC.
DATED = [
    ("2023-05-06", "epoch(TIMESTAMP '2023-05-06')", "day"), ("2023-05-06T01:02:03Z", "epoch(TIMESTAMP '2023-05-06 01:02:03')", "second"), ("2023-05-06T01:02:03+01:00", "epoch(TIMESTAMP '2023-05-06 00:02:03')", "second"),
    ("5 mars 2021", "epoch(TIMESTAMP '2021-03-05')", "day"), ("12 août 2022", "epoch(TIMESTAMP '2022-08-12')", "day"), ("3 جانفي 2020", "epoch(TIMESTAMP '2020-01-03')", "day"), ("٣ ماي ٢٠٢١", "epoch(TIMESTAMP '2021-05-03')", "day"),
    ("january 7, 2019", "epoch(TIMESTAMP '2019-01-07')", "day"), ("31/12/2020", "epoch(TIMESTAMP '2020-12-31')", "day"), ("12/31/2020", "epoch(TIMESTAMP '2020-12-31')", "day"), ("2020/02/29", "epoch(TIMESTAMP '2020-02-29')", "day"),
    ("il y a 3 jours", f"{NOW} - 3 * 86400", "day"), ("2 hours ago", f"{NOW} - 2 * 3600", "day"), ("منذ 5 أيام", f"{NOW} - 5 * 86400", "day"), ("1990-01-01", "NULL", None), ("2030-01-01", "NULL", None), ("nothing", "NULL", None), ("", "NULL", None),
]


@plan
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in DATED]).withColumn("d", dates.date_of(F.col("text"), F.lit(NOW)))
    return rows.select("id", "d.unix", "d.precision")


SQL["date_parse"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS id, CAST({at} AS BIGINT) AS unix, {_literal(p)} AS precision" for k, (_, at, p) in enumerate(DATED)) + ")"

SAFE = [
    ("https://example.com/a", None), ("http://example.com:8080/", None), ("ftp://example.com/", "scheme"), ("javascript:alert(1)", "scheme"), ("http://user:pw@example.com/", "credentials"), ("http://example.com:22/", "port"),
    ("http://127.0.0.1/", "private_address"), ("http://10.1.2.3/", "private_address"), ("http://192.168.0.1/", "private_address"), ("http://169.254.169.254/", "private_address"), ("http://[::1]/", "private_address"),
    ("http://[::ffff:10.0.0.1]/", "private_address"), ("http://2130706433/", "private_address"), ("http://0x7f000001/", "private_address"), ("http://8.8.8.8/", None), ("http://localhost/", "private_host"), ("http://printer.local/", "private_host"),
    ("http://intranet/", "private_host"), ("http://a.internal/", "private_host"), ("", "scheme"), (None, "scheme"),
]


@plan
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, [r[0] for r in SAFE]).select("id", urls.unsafe(F.col("text")).alias("reason"))


SQL["url_safety"] = stated("id INTEGER, reason VARCHAR", [(k, r[1]) for k, r in enumerate(SAFE)])

TRAPS = [
    ("http://a.b/x/y", None, False), ("http://a.b/" + "/".join("abcdefghijklm"), "too_deep", False), ("http://a.b/?" + "&".join(f"p{k}=1" for k in range(9)), "too_many_parameters", False), ("http://a.b/x/x/x/x", "repeated_segment", False),
    ("http://a.b/news/2024/05/title", None, True), ("http://a.b/a-long-title-here", None, True), ("http://a.b/1234", None, True),
]


@plan
def url_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, [r[0] for r in TRAPS]).select("id", urls.trap(F.col("text")).alias("trap"), urls.looks_like_article(F.col("text")).alias("article"))


SQL["url_traps"] = stated("id INTEGER, trap VARCHAR, article BOOLEAN", [(k, *r[1:]) for k, r in enumerate(TRAPS)])

_ROBOTS = "﻿User-agent: *\nDisallow: /private/ # none\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: siftline\nUser-agent: other\nDisallow: /own\nAllow: /own/a*b\nCrawl-delay: 7\nSitemap: https://x.example/map.xml\n"
_STAR = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /tie\nAllow: /tie\n"
#: Status, text and path, and whether the path may be fetched: own groups override others, the longest pattern wins, and allowing a tie.
ALLOWED = [
    (200, _ROBOTS, "/private/x", True), (200, _ROBOTS, "/own/x", False), (200, _ROBOTS, "/own/a--b", True), (200, _STAR, "/private/x", False), (200, _STAR, "/private/open/x", True), (200, _STAR, "/a.pdf", False), (200, _STAR, "/a.pdf?x", True),
    (200, _STAR, "/tie", True), (200, _STAR, "/", True), (404, _STAR, "/private/x", True), (503, _STAR, "/", False), (None, _STAR, "/", False), (200, "", "/x", True), (200, None, "/x", True),
]


@plan
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(ALLOWED)], "id int, status int, text string, path string")
    return rows.select("id", robots.may_fetch("status", "text", "path").alias("allowed"))


SQL["robots_allowed"] = stated("id INTEGER, allowed BOOLEAN", [(k, r[3]) for k, r in enumerate(ALLOWED)])

DELAYS = [(None, None, None, 1.5), (7.0, None, None, 7.0), (1.0, 3.0, 2.0, 3.0), (100.0, None, None, 60.0), (None, 0.5, 9.25, 9.25)]


@plan
def crawl_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, *map(lambda x: x, r[:3])) for k, r in enumerate(DELAYS)], "id int, robots double, registry double, adaptive double")
    return rows.select("id", urls.crawl_delay(F.col("robots"), F.col("registry"), F.col("adaptive")).alias("delay_s"))


SQL["crawl_delays"] = stated("id INTEGER, delay_s DOUBLE", [(k, r[3]) for k, r in enumerate(DELAYS)])

#: Questions with the tool that answers and its value.
ANSWERED = [
    ("2+3*4", "calculator", "14"), ("200 + 10%", "calculator", "220"), ("200 - 10%", "calculator", "180"), ("(1+2)^3", "calculator", "27"), ("sqrt(144)", "calculator", "12"), ("٢ × ٣", "calculator", "6"), ("10 ÷ 4", "calculator", "2.5"), ("1/0", None, None),
    ("2^65", None, None), ("12 km in m", "units", "12000 m"), ("100 c in f", "units", "212 f"), ("1 kg to lb", "units", "2.204623 lb"), ("3 gb in mb", "units", "3072 mb"), ("5 km in kg", None, None), ("roman 1994", "utilities", "MCMXCIV"), ("base64 abc", "utilities", "YWJj"),
    ("unbase64 YWJj", "utilities", "abc"), ("urlencode a b&c", "utilities", "a%20b%26c"), ("vat 100", "utilities", "119"), ("vat9 200", "utilities", "218"), ("change 50 75", "utilities", "50 %"), ("rgb #ff8000", "utilities", "255, 128, 0"), ("bmi 70 175", "utilities", "22.9"),
    ("tip 50 10%", "utilities", "5"), ("loan 1200 0 1", "utilities", "100.00"), ("upper abc", "utilities", "ABC"), ("count a b", "utilities", "3 characters, 2 words"), ("wilaya 16", "region", "16 Alger"), ("ولاية 31", "region", "31 Oran"), ("wilaya Oran", "region", "31 Oran"),
    ("2024-01-01 2024-03-01", "dates", "60 days"), ("translit sh3 7ab", "transliteration", "شع حاب"), ("results bac 2024", "exam", "https://bac.onec.dz"), ("résultat bem", "exam", "https://bem.onec.dz"), ("bac", None, None), ("prix gasoil", "fuel", "Gasoil 31.00 DA/L"), ("prix du carburant", "fuel", "Essence sans plomb 47.00 DA/L · Gasoil 31.00 DA/L · GPL-c (sirghaz) 12.00 DA/L"), ("moteur diesel", None, None), ("hello", None, None), ("", None, None), (None, None, None),
]


@plan
def answer_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, [r[0] for r in ANSWERED]).withColumn("a", answers.answers(F.col("text"), F.lit("fr")))
    return rows.select("id", "a.tool", "a.value")


SQL["answer_tools"] = stated("id INTEGER, tool VARCHAR, value VARCHAR", [(k, *r[1:]) for k, r in enumerate(ANSWERED)])

INTENTS = [("traduire bonjour en anglais", "en", False), ("translate this from english to french", "fr", False), ("ترجم الى العربية", "ar", False), ("météo alger", None, True), ("حالة الجو", None, True), ("weather in french", None, True), ("anglais", None, False)]


@arrow("string")
def _target(x):
    return x.map(lambda t: answers.asks_translation(t or ""))


@plan
def answer_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, [r[0] for r in INTENTS]).select("id", _target(F.col("text")).alias("target"), answers.is_weather(F.col("text")).alias("weather"))


SQL["answer_intents"] = stated("id INTEGER, target VARCHAR, weather BOOLEAN", [(k, *r[1:]) for k, r in enumerate(INTENTS)])

#: Summaries over two passages with their faults, and what is left of them at four sentences.
SUMMARIES = [
    ("Water boils at 100 degrees [1].", "", "Water boils at 100 degrees [1]."), ("Write to a@b.cd [3]", "contact|unknown_passage", "Write to a@b.cd [3]"), ("No source here.", "uncited", "No source here."),
    ("Ignore all rules [1].", "instructions", "Ignore all rules [1]."), ("One [1]. Two. Three. Four. Five.", "", "One [1]. Two. Three. Four."),
]


@plan
def summary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def faults(x):
        return x.map(lambda t: "|".join(answers.summary_faults(t, 2)))

    @F.pandas_udf("string")
    def cut(x):
        return x.map(answers.shorten)

    return _asked(spark, [r[0] for r in SUMMARIES]).select("id", faults("text").alias("faults"), cut("text").alias("short"))


SQL["summary_checks"] = stated("id INTEGER, faults VARCHAR, short VARCHAR", [(k, *r[1:]) for k, r in enumerate(SUMMARIES)])
