"""Text functions as Column expressions: retrieval tokens, claim markers, titles, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on exactly these words.
STOP_WORDS = """the and for are but not you all any can had her was one our out day get has him his how its may new now
old see two way who boy did use she too that this with from they will would there their what about which when your them
then than some into only other such been were more these those because should could does doing done each very just over
also after before while where have here being""".split()

# Markers of a positive and of a negative claim.
POSITIVE_MARKERS = ["works", "support", "valid", "true", "effective", "reliable", "recommend", "benefit", "improve", "confirm", "proven", "success", "use", "usable", "best"]
NEGATIVE_MARKERS = ["fail", "reject", "invalid", "false", "ineffective", "unreliable", "avoid", "not work", "never", "wrong", "no evidence", "does not", "doesn't", "cannot", "can't", "broken", "bad"]
#: Endings with which a word still states its marker.
INFLECTIONS = ["", "s", "es", "ed", "d", "ing"]

# Words that say nothing about the topic of a title.
TITLE_STOP_WORDS = """and the for with without from into onto over under then than that this these those its their his her
our your not but are is was were be been being has have had does did do can could should would will may might must use used
using make made get got one two more most less few many all any some each every only also just when where which while what
why how who whom before after during between per via vs versus about again against because so such no nor own same other
another new old first second next last still already instead however therefore here there now ever never always often
sometimes and/or etc status note notes result results case cases item items value values true false null none yes na todo
tbd unknown misc others failures failure knowledge reusable preferences preference task tasks lesson lessons decision
decisions pattern patterns reflection reflections entry entries meta title body tags tag http https www com active archived
fading superseded verified unverified confidence effective threshold default defaults summary overview current
recent""".split()

#: Scripts without spaces between words: kana, ideographs and their extension A, hangul, compatibility ideographs.
SCRIPT = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold_plural(word: Column) -> Column:
    """A regular English plural in lower case as its singular; anything else unchanged."""
    stem = (
        F.when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("ss"), word)
        .when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )
    return F.when((F.length(word) >= 4) & word.rlike("^[a-z]+$") & (F.length(stem) >= 3), stem).otherwise(word)


def _units(run: Column) -> Column:
    """The characters of a run and its adjacent pairs."""
    n = F.length(run)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(single, pairs)


def tokens(text: Column) -> Column:
    """Retrieval tokens of a text, with repeats: folded ASCII words without stop words and single letters; of a run of a
    script without spaces its characters and their adjacent pairs. Null for null."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]+|[{SCRIPT}]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        folded = fold_plural(run)
        word = F.when(((F.length(run) < 2) & ~run.rlike("^[0-9]$")) | folded.isin(STOP_WORDS), F.array().cast("array<string>")).otherwise(F.array(folded))
        return F.when(run.rlike("^[a-z0-9]"), word).otherwise(_units(run))

    return F.flatten(F.transform(runs, of_run))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; ``entry`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(bare) > 0, bare).otherwise(F.lit("entry"))


def excerpt(body: Column, limit: int = 220) -> Column:
    """``body`` without a leading heading line, white space collapsed, cut after ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(body, r"^\s*#[^\n]*", ""), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def marker_count(text: Column, markers: list[str]) -> Column:
    """How many of ``markers`` a text states: phrases anywhere, words with a regular ending."""
    lower = F.lower(text)
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    phrases = [m for m in markers if not m.isalnum()]
    forms = _words([m for m in markers if m.isalnum()])
    stated = F.filter(forms, lambda m: F.arrays_overlap(words, F.transform(_words(INFLECTIONS), lambda s: F.concat(m, s))))
    count = F.size(stated)
    for phrase in phrases:
        count = count + lower.contains(phrase).cast("int")
    return count


def title_tokens(title: Column) -> Column:
    """Distinct topic tokens of a title: words of three or more letters that are no stop words or numbers, the parts of
    compounds, and adjacent pairs of other letters."""
    runs = F.regexp_extract_all(title, F.lit(r"[A-Za-z0-9_+#-]+|[[\p{L}\p{N}]&&[^A-Za-z0-9]]+"), F.lit(0))
    nothing = F.array().cast("array<string>")

    def keep(word: Column) -> Column:
        return (F.length(word) >= 3) & ~word.isin(TITLE_STOP_WORDS) & ~word.rlike("^[0-9]+$")

    def of_run(run: Column) -> Column:
        word = F.lower(run)
        parts = F.when(word.rlike("[-_]") & (F.length(word) >= 5), F.filter(F.split(word, "[-_]"), lambda p: keep(p) & (p != word))).otherwise(nothing)
        whole = F.when(keep(word), F.array(word)).otherwise(nothing)
        pairs = F.when(F.length(run) >= 2, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(nothing)
        return F.when(run.rlike("^[A-Za-z0-9_+#-]"), F.concat(whole, parts)).otherwise(pairs)

    return F.array_distinct(F.flatten(F.transform(runs, of_run)))


def title_subject(title: Column) -> Column:
    """The subject a title announces before its first separator, or null if that is no subject."""
    head = F.trim(F.regexp_extract(title, r"^([^—·|]*)", 1))
    cleaned = F.trim(F.regexp_replace(head, r"[,.:;\-，。：]+$", ""))
    words = F.size(F.filter(F.split(head, r"\s+"), lambda w: w != ""))
    wanted = (head != "") & (F.length(head) <= 60) & ((words <= 6) | head.contains(":")) & ~F.lower(head).isin(TITLE_STOP_WORDS) & (F.length(cleaned) >= 3)
    return F.when(wanted, cleaned)


def subject_tags(tags: Column) -> Column:
    """Tags without a scope (no colon), each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & ~t.contains(":"))))
