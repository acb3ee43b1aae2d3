"""Garbled text from a wrong character encoding: found, explained by clean twins, and restored.

1. Every text gives its *words* with characters beyond ASCII (runs between white space), each under the key of its twins:
   its text stripped of non-ASCII characters, every run of these left open, or, where no ASCII letters are left, that of
   the words beside it (letters and digits reduced to their shape). They are counted once over all documents.
2. Alignment. A word is joined with the most common word of the same key and the size it would have in bytes, if that is at
   least ``TWIN_TIMES`` as common. The two are aligned character by character: ASCII with ASCII, and each character of the
   garbled word with the byte of the clean one that stands there. That yields pairs of character and byte; a code page
   explains the word if it reads all those bytes as those characters.
3. Mappings. Pairs (read as, written as) are chosen by how many distinct aligned words only they explain; each must have
   ``TWINS``. The characters that words use often are the alphabet.
4. The learned mappings are applied to all records in one scan: a stretch that a mapping turns into characters of the
   alphabet is garbled and has its original. Replacement and C1 control characters, what decoders leave where no character
   was, are garbled too; what was lost is looked up among the clean twins of the word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.staging import staged

#: Encodings of the standard library that alignment may find: single-byte code pages a text may have been read as, in the
#: order in which equal evidence counts, wide encodings, and Cyrillic ones.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "mac_latin2", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-15")
WIDE, NARROW = ("gbk", "big5", "shift_jis"), ("cp1251", "koi8-r", "cp866")
#: Distinct garbled words with a twin that a pair needs to be learned, and how much more common a twin is.
TWINS, TWIN_TIMES = 3, 2
#: Words, over all rows, that a character of the alphabet occurs in at least, and the share of a stretch that must be of it.
USES, KNOWN_SHARE = 3, 0.8
#: How much likelier (mean logarithm of the count of its pairs of letters) a stretch must be in Cyrillic than as it stands.
LIKELIER = 1.0
#: Words a task counts before it passes them on.
HELD_WORDS = 200_000

_WORD = r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*"
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_UTF8_CJK = re.compile(rb"(?:[\xe4-\xe9][\x80-\xbf]{2}|\xef\xbc[\x80-\xbf]|\xe3\x80[\x80-\xbf]){3,}")
_UTF8_CJK_ALL = re.compile(rb"(?:[\x00-\x7f]|[\xe4-\xe9][\x80-\xbf]{2}|\xef\xbc[\x80-\xbf]|\xe3\x80[\x80-\xbf])*")
#: What a piece of UTF-8 may begin and end with of a sequence broken off.
_TAIL, _HEAD = re.compile(rb"[\x80-\xbf]{0,2}"), re.compile(rb"[\xe3-\xe9\xef][\x80-\xbf]?\Z")
#: Characters that only a wide encoding holds, and those beyond ASCII that a single-byte one may hold.
_WIDE_CHAR, _NARROW_CHAR = re.compile("[\u2e80-\U0010ffff]"), re.compile("[\x80-\u2e7f]")
_C1 = re.compile("[\x80-\x9f]")
_LOST = re.compile("[\x80-\x84\x86-\x9f�]")


def to_bytes(text: str, encoding: str) -> bytes:
    """The bytes that ``encoding`` reads as ``text``; bytes that a Windows code page leaves open count as themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125") or not _C1.search(text):
            raise
    return b"".join(bytes((ord(c),)) if 0x80 <= ord(c) < 0xA0 else c.encode(encoding) for c in text)


@lru_cache(None)
def _repertoire(encoding: str) -> re.Pattern:
    """Runs of at least two characters beyond ASCII that a single-byte encoding can hold."""
    high = {bytes((i,)).decode(encoding, "ignore") for i in range(128, 256)} | ({chr(i) for i in range(128, 160)} if encoding.startswith("cp125") else set())
    return re.compile("[" + re.escape("".join(sorted(c for c in high if c and ord(c) > 127))) + "]{2,}")


def repairs(word: str, pairs: tuple[tuple[str, str], ...], known, depth: int = 3, likelier=lambda a, b: True) -> str | None:
    """``word`` with its garbled stretches turned back, or None if it has none that the pairs explain.

    ``known`` tells whether a character belongs to the alphabet, ``likelier`` whether letters are likelier than others.
    Text garbled more than once is turned back as often.
    """
    best, gain = None, 0
    wide, narrow = _WIDE_CHAR.search(word), _NARROW_CHAR.search(word)
    for pair in pairs:
        if not (wide if pair[0] == "gbk" else narrow):
            continue
        if pair[0] == "utf-8":  # characters were lost: nothing to turn back
            continue
        out = _repaired(word, pair, known, depth, likelier)
        if out is not None and len(word) - len(out) + 1 > gain:
            best, gain = out, len(word) - len(out) + 1
    return best


def _settled(text: str, pairs_read: str, known, depth: int) -> str | None:
    """``text``, or what it is turned back to again, if all its characters belong to the alphabet."""
    if depth > 1:
        again = _repaired(text, (pairs_read, "utf-8"), known, depth - 1)
        if again is not None:
            return again
    if _LOST.search(text):
        return None
    if len(text) <= 4:
        return text if all(map(known, text)) else None
    # many sequences in a row that make ideographs are never meant as they stand
    sure = sum(known(c) or "\u4e00" <= c <= "\u9fff" for c in text)
    return text if sure >= KNOWN_SHARE * len(text) else None


def _repaired(word: str, pair: tuple[str, str], known, depth: int, likelier=lambda a, b: True) -> str | None:
    read, written = pair
    changed = False
    if read == "gbk":
        return _repaired_gbk(word, known)

    def turn(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        raw = to_bytes(run, read)
        if written == "utf-8":
            parts, done = [], 0
            for u in _UTF8.finditer(raw):
                try:
                    text = _settled(u.group().decode("utf-8"), read, known, depth)
                except UnicodeError:
                    text = None
                if text is not None:
                    parts += [run[done : u.start()], text]
                    done, changed = u.end(), True
            return "".join(parts) + run[done:]
        try:
            text = raw.decode(written)
        except UnicodeError:
            return run
        beside = word[max(0, m.start() - 1) : m.start()] + word[m.end() : m.end() + 1]
        inside = any(c.isascii() and c.isalpha() for c in beside)  # of a word in Latin letters
        if inside and (written in NARROW or len(text) < 3):
            return run
        if written in NARROW and (len(run) < 3 or not all(c.isalpha() for c in text) or not likelier(text, run)):
            return run
        if written in WIDE and not all(c >= "\u2e80" or "\u2500" <= c <= "\u257f" for c in text):
            return run
        if sum(map(known, text)) < (KNOWN_SHARE * len(text) if len(text) > 4 else len(text)):
            return run
        changed = True
        return text

    out = _repertoire(read).sub(turn, word)
    return out if changed else None


@lru_cache(None)
def _gbk_runs() -> re.Pattern:
    """Runs of characters that GBK can encode."""
    high = [c for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and (c := chr(i)).encode("gbk", "ignore")]
    return re.compile("[\x00-\x7f" + re.escape("".join(high)) + "]+")


def _repaired_gbk(word: str, known) -> str | None:
    """UTF-8 read as GBK turned back, in the pieces of ``word`` between characters that GBK lacks.

    Once a piece shows three characters of UTF-8 in a row, single ones count in pieces of nothing else but ASCII. What is left of a
    sequence that a piece breaks off is one lost character, with the replacement character beside it if there is one.
    """
    runs = _gbk_runs()
    pieces = [(m.start(), m.end(), m.group().encode("gbk")) for m in runs.finditer(word)]
    valid = lambda raw: all(c.isascii() or known(c) for c in raw.decode("utf-8"))
    if not any(valid(m.group()) for *_, raw in pieces for m in _UTF8_CJK.finditer(raw)):
        return None
    out, at = [], 0
    for start, end, raw in pieces:
        out.append(word[at:start])
        at = end
        before, after = word[start - 1 : start], word[end : end + 1]
        first = len(_TAIL.match(raw).group()) if before else 0
        last = len(raw) - (len(m.group()) if after and (m := _HEAD.search(raw, first)) else 0)
        inner = raw[first:last]
        lost = (not first or before == "\ufffd") and (last == len(raw) or after == "\ufffd")  # nothing but what was broken off
        if (m := _UTF8_CJK_ALL.fullmatch(inner)) and valid(inner) and (lost or not inner.isascii()):
            found = [m]
        else:
            found = [m for m in _UTF8_CJK.finditer(inner) if valid(m.group())]
        if not found:
            out.append(word[start:end])
            continue
        done = first if found[0].start() == 0 else 0
        if done and before != "\ufffd":
            out.append("\ufffd")
        for m in found:
            out += [raw[done : first + m.start()].decode("gbk", "replace"), m.group().decode("utf-8")]
            done = first + m.end()
        if done == last < len(raw):
            out.append("\ufffd" if after != "\ufffd" else "")
        else:
            out.append(raw[done:].decode("gbk", "replace"))
    return "".join(out) + word[at:]


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


_OPEN = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[A-Za-z]")
_DIGITS, _SHAPE = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")


def twin_key(word: str, before: str, after: str) -> str:
    """What a word with characters beyond ASCII and its twins have in common; see the module's first step."""
    open_ = _OPEN.sub("\x00", word)
    if len(_LETTERS.findall(open_)) >= 2:
        return _DIGITS.sub("0", open_)
    shape = lambda w: _SHAPE.sub("a", _DIGITS.sub("0", _OPEN.sub("\x00", w)))
    return f"{shape(before)} {_DIGITS.sub('0', open_)} {shape(after)}"


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(_WORD)
    held: Counter = Counter()

    def passed() -> pa.RecordBatch:
        keys, words = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words), pa.array(list(held.values()), pa.int64())], names=["key", "word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text is None or text.isascii():
                continue
            seen = set()
            for line in text.splitlines():
                if not line.isascii():
                    tokens = line.split(" ")
                    seen.update((twin_key(t, tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""), t) for i, t in enumerate(tokens) if not t.isascii())
            held.update(seen)
        if len(held) > HELD_WORDS:
            yield passed()
            held.clear()
    if held:
        yield passed()


def lexicon(documents: DataFrame, text: str = "text") -> DataFrame:
    """key, word, n: each word with characters beyond ASCII under the key of its twins, and the number of rows that have it
    there."""
    counted = documents.select(text).mapInArrow(_counter, "key string, word string, n bigint")
    return counted.groupBy("key", "word").agg(F.sum("n").alias("n"))


def _sizes(word: Column) -> tuple[Column, Column, Column]:
    """Characters, bytes in UTF-8, and bytes in an encoding of one byte for ASCII and two for all else."""
    chars, octets = F.length(word), F.octet_length(word)
    return chars, octets, 2 * chars - F.length(F.regexp_replace(word, r"[^\x00-\x7f]+", ""))


@lru_cache(None)
def _readers() -> dict[str, list[int]]:
    """Character -> for each byte the code pages (as bits of ``READ_AS``) that read it so. Bytes that a Windows code page
    leaves open count as the control characters of their numbers."""
    out: dict[str, list[int]] = {}
    for k, page in enumerate(READ_AS):
        for byte in range(128, 256):
            c = bytes((byte,)).decode(page, "ignore")
            if not c and page.startswith("cp125") or page.startswith("cp125") and byte < 160:
                out.setdefault(chr(byte), [0] * 256)[byte] |= 1 << k
            if c:
                out.setdefault(c, [0] * 256)[byte] |= 1 << k
    return out


def explained(garbled: str, clean: str) -> Iterator[tuple[str, str]]:
    """(written as, read as, joined by ``|`` if several) for every way in which ``garbled`` is ``clean`` wrongly read.

    The words are aligned place by place: each character beyond ASCII of ``garbled`` with the byte of ``clean`` at its
    place, ASCII with itself.
    """
    readers = _readers()
    for written in ("utf-8", *WIDE, *NARROW):
        try:
            raw = clean.encode(written)
        except UnicodeError:
            continue
        if len(raw) == len(garbled):
            pages = -1
            for c, byte in zip(garbled, raw):
                if byte < 128 or c < "\x80":
                    pages = pages if ord(c) == byte else 0
                else:
                    pages &= readers[c][byte] if c in readers else 0
                if not pages:
                    break
            names = [p for k, p in enumerate(READ_AS) if pages >> k & 1 and p != written]
            if pages > 0 and names:
                yield written, "|".join(names)
        if written == "utf-8" and garbled == raw.decode("gbk", "replace"):
            yield written, "gbk"
    if "\ufffd" in garbled:
        for written in ("cp1252", *NARROW):
            try:
                if clean.encode(written).decode("utf-8", "replace") == garbled:
                    yield written, "utf-8"
                    return
            except UnicodeError:
                continue


def _aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(g, c, n, m, written, read) for g, c, n, m in zip(*(batch.column(i).to_pylist() for i in range(4))) for written, read in explained(g, c)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["garbled", "word", "n", "n_clean", "written_as", "read_as"])


def twins(words: DataFrame) -> DataFrame:
    """Garbled words of a lexicon aligned with their clean twins: garbled, word, n, n_clean, written_as, read_as (all code
    pages that explain the word, joined by ``|``).

    The twin of a word is the most common word of its key among those whose bytes, in UTF-8, in two bytes for each
    character beyond ASCII, or in one, are as many as the garbled word has characters.
    """
    chars, octets, doubled = _sizes(F.col("word"))
    narrow = ~F.col("word").rlike("[\u2e80-\ufffc\U00010000-\U0010ffff]")  # the replacement character may stand for any
    kinds = [("utf-8", octets, chars, F.lit(True)), ("utf-8 in pairs", F.ceil(octets / 2).cast("int"), chars, ~narrow), ("double", doubled, chars, F.lit(True)), ("single", chars, chars, narrow)]
    size_of = lambda at: F.filter(F.array(*[F.when(k[3], F.struct(F.lit(k[0]).alias("kind"), k[at].alias("size"))) for k in kinds]), lambda x: x.isNotNull())
    clean = words.where(F.col("n") >= TWIN_TIMES).select("key", "word", "n", F.inline(size_of(1))).where(~F.col("word").contains("\ufffd"))
    best = clean.groupBy("key", "kind", "size").agg(F.max(F.struct("n", "word")).alias("_best"))
    asked = words.select("key", F.col("word").alias("garbled"), "n", F.inline(size_of(2)))
    pairs = asked.join(best, ["key", "kind", "size"]).where((F.col("_best.word") != F.col("garbled")) & (F.col("_best.n") >= TWIN_TIMES * F.col("n")))
    once = pairs.select("garbled", F.col("_best.word").alias("word"), "n", F.col("_best.n").alias("n_clean")).groupBy("garbled", "word").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))
    return once.mapInArrow(_aligner, "garbled string, word string, n bigint, n_clean bigint, written_as string, read_as string")


def mappings(aligned: DataFrame) -> list[tuple[str, str, int]]:
    """(read as, written as, words): the pairs of encodings that explain most of the aligned words, each with the words that
    no pair before it explains; pairs with fewer than ``TWINS`` are left out.

    Words are counted by the set of pairs that explain them; the driver sees these counts, whose number depends on the
    code pages and not on the corpus.
    """
    every = F.flatten(F.collect_list(F.transform(F.split("read_as", r"\|"), lambda r: F.concat(r, F.lit(" "), F.col("written_as")))))
    sets = aligned.groupBy("garbled", "word").agg(F.array_join(F.array_sort(F.array_distinct(every)), "|").alias("ways"))
    left = {r["ways"]: r["k"] for r in sets.groupBy("ways").agg(F.count_distinct("garbled").alias("k")).collect()}
    order = {(r, w): (i, j) for i, w in enumerate(("utf-8", *WIDE, *NARROW, "cp1252")) for j, r in enumerate((*READ_AS, "gbk", "utf-8"))}
    out = []
    while left:
        score: dict[tuple[str, str], int] = {}
        for ways, k in left.items():
            for way in ways.split("|"):
                pair = tuple(way.split(" "))
                score[pair] = score.get(pair, 0) + k
        pair = max(score, key=lambda p: (score[p], [-x for x in order[p]]))
        if score[pair] < TWINS:
            break
        out.append((*pair, score[pair]))
        left = {ways: k for ways, k in left.items() if " ".join(pair) not in ways.split("|")}
    return out


def _pairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in zip(word.lower(), word.lower()[1:]):
                if "\u0400" <= a <= "\u04ff" and "\u0400" <= b <= "\u04ff":
                    held[a + b] += n
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["pair", "n"])


def learned(words: DataFrame) -> tuple[tuple[tuple[str, str], ...], frozenset[str], dict[str, int]]:
    """The mappings (read as, written as) that the lexicon's twins show, the alphabet, and, if a mapping restores Cyrillic, how
    often each pair of its letters occurs (at most 256 x 256)."""
    pairs = tuple((r, w) for r, w, _ in mappings(twins(words)))
    letters = words.select("n", F.explode(F.array_distinct(F.split(F.regexp_replace("word", r"[\x00-\x7f]+", ""), ""))).alias("c")).groupBy("c").agg(F.sum("n").alias("uses"))
    alphabet = letters.where((F.col("uses") >= USES) & (F.length("c") == 1)).select("c").collect()  # at most the characters of Unicode
    beside = {}
    if any(w in NARROW for _, w in pairs):
        counted = words.where(F.col("word").rlike("[\u0400-\u04ff]{2}")).select("word", "n").mapInArrow(_pairer, "pair string, n bigint")
        beside = {r["pair"]: r["n"] for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    return pairs, frozenset(r["c"] for r in alphabet if not _LOST.match(r["c"])), beside


def likelier(counts: dict[str, int], text: str, other: str) -> bool:
    """Whether the pairs of letters of ``text`` are clearly more common than those of ``other``."""
    mean = lambda t: sum(math.log1p(counts.get(a + b, 0)) for a, b in zip(t, t[1:])) / max(1, len(t) - 1)
    return mean(text.lower()) >= mean(other.lower()) + LIKELIER


def _scanner(shared, restore: bool):
    word = re.compile(_WORD)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, alphabet, beside = shared.value
        known = alphabet.__contains__
        better = partial(likelier, beside)

        @lru_cache(1 << 16)
        def repaired(w: str) -> str | None:
            return repairs(w, pairs, known, likelier=better)

        for batch in batches:
            ids, texts, lost, turned = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or text.isascii():
                    continue
                found = bool(_LOST.search(text))
                if not restore:  # a sign that something was lost settles it
                    if found or any(repaired(m.group()) is not None for m in word.finditer(text)):
                        ids.append(i)
                    continue
                out = word.sub(lambda m: m.group() if (r := repaired(m.group())) is None else r, text)
                if found or out != text:
                    ids.append(i), texts.append(out), lost.append(len(_LOST.findall(out))), turned.append(out != text)
            if ids:
                columns = [pa.array(ids, batch.column(0).type)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string()), pa.array(lost, pa.int32()), pa.array(turned)] if restore else []), names=["doc_id", "text", "n_lost", "turned"][: 4 if restore else 1])

    return scan


def garbled_documents(documents: DataFrame, restore: bool = False) -> DataFrame:
    """doc_id of each document with garbled text; with ``restore`` also its text turned back where the learned mappings can,
    ``n_lost``, the characters that stay lost (see :func:`lost_words`), and ``turned``, whether a mapping turned any back.

    ``documents``: doc_id, text; other columns are ignored. Null, empty and ASCII texts are not garbled; a null doc_id
    comes out as null; repeated rows come out as often; an empty table gives an empty result. Whole texts are read.
    """
    rows = documents.select("doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(learned(staged(lexicon(rows))))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanner(shared, restore), f"doc_id {kind}" + (", text string, n_lost int, turned boolean" if restore else ""))


def open_pattern(word: Column) -> Column:
    """A word with every run of characters beyond ASCII left open."""
    return F.regexp_replace(word, r"[^\x00-\x7f]+", "\x00")


def lost_words(restored: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, lost_word, word: words that still hold replacement characters, with their most common clean twin (null
    where there is none, or nothing but the lost characters to go by)."""
    lost = restored.where("n_lost > 0").select("doc_id", F.explode(F.filter(_words(F.col("text")), lambda w: w.contains("�"))).alias("lost_word"))
    bare = F.regexp_replace("word", r"[^\x00-\x7f]+", "")
    clean = words.groupBy("word").agg(F.sum("n").alias("n")).where(~F.col("word").contains("�") & (F.length(bare) > 0)).groupBy(open_pattern(F.col("word")).alias("_open")).agg(F.max(F.struct("n", "word")).alias("_best"))
    return lost.withColumn("_open", open_pattern(F.col("lost_word"))).join(clean, "_open", "left").select("doc_id", "lost_word", F.col("_best.word").alias("word"))
