"""Cut values, leaked passages, mixtures, encodings: small fixtures with every dirty case."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.llm import encodings as E
from lorespark.llm import leakage as L
from lorespark.llm import mixing as M
from lorespark.llm import truncation as C

VALUE = "source_table string, record_id string, turn_id string, field_name string, source string, text string, t string, line string, cut string"


def values(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VALUE)


def cut(spark, rows):
    return {r["record_id"] for r in C.judged_values(values(spark, rows)).where("cut").collect()}


def test_cut_values_without_a_limit(spark):
    whole = {
        "w1": ("response", "All is well."),
        "w2": ("response", "See:\n\n```\nrun x --now\n```"),
        "w3": ("response", "Touched files:\n- src/a.py\n- lib/b.json"),
        "w4": ("response", "Done.\n\n$ tool run north-queue"),
        "w5": ("response", "Done.\n\nSee docs/guide.md"),
        "w6": ("response", "We tried the others, and so on …"),
        "w7": ("prompt", "rerun north-queue"),
        "w8": ("response", "复盘结束。"),
        "w9": ("response", "He said “no.”"),
        "w10": ("response", ""),
        "w11": ("response", None),
        "w12": ("response", "  \n\t "),
    }
    broken = {
        "c1": ("response", "All is well. The next sen"),
        "c2": ("response", "It stops here [truncated]"),
        "c3": ("response", "It stops\n[transfer interrupted]"),
        "c4": ("response", "It stops in a wo…"),
        "c5": ("response", "It stops in a wo..."),
        "c6": ("response", "It has half a character�"),
        "c7": ("response", "Open:\n\n```\nrun x"),
        "c8": ("prompt", "Can you look at the north queue and tell"),
        "c9": ("response", "Look at src/par."),
        "c10": ("response", "复盘没有结"),
        "c11": ("response", "long " * 50_000 + "and then"),
    }
    rows = [("t", k, None, f, "a", x) for k, (f, x) in (whole | broken).items()]
    assert cut(spark, rows + rows) == set(broken)
    assert cut(spark, []) == set()
    assert cut(spark, [("t", None, None, "response", "a", "no reco"), ("t", "n", None, None, None, "no field na")]) == {"n"}


def test_a_limit_shows_as_a_spike(spark):
    rng = random.Random(1)
    text = lambda n: ("word " * 100)[:n]
    rows = [("t", f"s{i}", "", "response", " Host ", text(rng.randint(20, 60)) + ".") for i in range(60)]
    rows += [("t", f"l{i}", "", "response", "host", "- src/x.py, and some more words to fill it up so that it is seventy-nine.py"[:75].ljust(78, "x") + " a") for i in range(8)]
    rows += [("t", "end", "", "response", "host", text(79) + ".")]
    facts = C.end_facts(values(spark, rows))
    assert {(r["unit"], r["limit"]) for r in C.length_spikes(facts).collect()} == {("n_chars", 80), ("n_bytes", 80)}
    got = cut(spark, rows)
    assert {f"l{i}" for i in range(8)} <= got and "end" not in got
    # values from before the limit do not hide it
    old = rows + [("t", f"m{i}", "", "response", "host", text(79) + ".") for i in range(40)] + [("t", f"old{k}", "", "response", "host", text(300 + 7 * k) + ".") for k in range(3)]
    assert {(r["unit"], r["limit"]) for r in C.length_spikes(C.end_facts(values(spark, old))).collect()} == {("n_chars", 80), ("n_bytes", 80)}
    few = rows + [("t", f"old{k}", "", "response", "host", text(300 + 7 * k) + ".") for k in range(3)]
    assert C.length_spikes(C.end_facts(values(spark, few))).isEmpty()


def test_whole_values_at_a_limit_stay_whole(spark):
    pad = lambda t: t.rjust(90, "x")
    rows = [("t", f"s{i}", "", "response", "host", "word " * (3 + i % 9) + "ends.\n\nSee docs/a.md") for i in range(40)]
    rows += [("t", f"l{i}", "", "response", "host", pad(" this is cut in the middle of a wo")) for i in range(9)]
    rows += [("t", "path", "", "response", "host", pad(" it is done.\n\nSee docs/guide.md")), ("t", "trails", "", "response", "host", pad(" we tried the others, and so on …")), ("t", "begun", "", "response", "host", pad(" it is done.\n\nSee docs/guide.m"))]
    assert cut(spark, rows) == {f"l{i}" for i in range(9)} | {"begun"}


def test_rates(spark):
    rows = [("t", f"{i}", "", "response", "A" if i % 2 else "a ", "Fine." if i < 8 else "Not fi") for i in range(10)]
    r = C.truncation_rates(C.judged_values(values(spark, rows))).first()
    assert (r["source"], r["n_values"], r["n_cut"], r["share_cut"]) == ("a", 10, 2, 0.2)


# leaked passages

ITEM = " ".join(f"word{i}" for i in range(30))


def leaked(spark, docs, items, n=13):
    d = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in docs], "doc_id bigint, text string, leaked string, _hashes string, item_id string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    return L.leaked_windows(d, i, n)


def test_leaks_whole_partial_and_in_other_spelling(spark):
    w = ITEM.split()
    docs = [(1, ITEM), (2, "before " + " ".join(w[3:16]) + " after"), (3, " ".join(w[3:15])), (4, "\n".join(w[5:20]).upper().replace("WORD", "Word") + "!"), (5, None), (6, ""), (7, "x " * 40_000 + " ".join(w[:13])), (2, "before " + " ".join(w[3:16]) + " after"), (8, "-".join(w[2:15])), (9, "_".join(w[2:15]))]
    items = [(10, ITEM), (10, ITEM), (11, " ".join(w[:14]) + " other"), (12, "short"), (13, None), (None, ITEM)]
    got = {tuple(r) for r in L.leaked_items(leaked(spark, docs, items)).collect()}
    assert got == {(1, 10), (1, 11), (2, 10), (4, 10), (7, 10), (7, 11), (8, 10), (9, 10)}
    assert L.leaked_items(leaked(spark, [], items)).isEmpty() and L.leaked_items(leaked(spark, docs, [])).isEmpty()


def test_leaks_with_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_GRAMS", 5)
    items = [(i, f"item{i} " + " ".join(f"w{i}x{k}" for k in range(15))) for i in range(6)]
    assert {tuple(r) for r in L.leaked_items(leaked(spark, [(i, t + " end") for i, t in items], items)).collect()} == {(i, i) for i in range(6)}


def test_spans_are_cut_out(spark):
    w = ITEM.split()
    rows = L.without_leaks(leaked(spark, [(1, "Keep this: " + ", ".join(w[:20]) + ". And this, too.")], [(10, ITEM)])).collect()
    assert [tuple(r) for r in rows] == [(1, "Keep this: . And this, too.", 20)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    draw = lambda n: [rng.choice("ab") for _ in range(n)]
    items = [(i, " ".join(draw(12))) for i in range(5)]
    docs = [(i, " ".join(draw(rng.randint(0, 30)))) for i in range(60)]
    grams = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    assert {tuple(r) for r in L.leaked_items(leaked(spark, docs, items, 8)).collect()} == {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


# mixtures


def test_water_filling():
    assert M.water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 10}, 60) == {"a": 50.0, "b": 10.0}
    assert M.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": None, "e": -1}, {"a": 5, "b": 100, "c": 100}, 55) == pytest.approx({"a": 5, "b": 30, "c": 20, "d": 0, "e": 0})
    assert M.water_fill({"a": 1.0}, {}, 10) == {"a": 0.0} and M.water_fill({}, {}, 10) == {} and sum(M.water_fill({"a": 1, "b": 1}, {"a": 3, "b": 4}, 100).values()) == 7


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, source string, text string, n_tokens string, repeats int")
    t = spark.createDataFrame([(*x, "clash") for x in targets], "source string, target_share double, max_repeats int, doc_id string")
    return M.mixture(d, t, **kw), t


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(5)
    docs = [(i, "big" if i < 400 else "small" if i < 440 else "other", "some words of a text " * rng.randint(1, 9)) for i in range(500)]
    docs += [docs[0], (1000, None, "x"), (1001, "big", None), (1002, "big", ""), (None, "big", "x")]
    chosen, targets = mix(spark, docs, [("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 9), (None, 0.1, 1)])
    rows = chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    assert max(r["repeats"] for r in rows if r["source"] == "small") == 3 and max(r["repeats"] for r in rows if r["source"] == "big") == 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(spark, docs, [("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 9)])[0].collect()))
    shares = {r["source"]: r for r in M.mixture_shares(chosen, targets).collect()}
    assert shares["none"]["n_tokens"] == 0 and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_fractions_are_met_to_one_document(spark, tokenizer):
    docs = [(i, "abc"[i % 3], "words and 123 more " * (1 + i % 5)) for i in range(300)]
    chosen, _ = mix(spark, docs, [("a", 1.0, 2), ("b", 1.0, 2), ("c", 2.0, 2)], total_tokens=2000, tokenizer=tokenizer)
    used = {r["source"]: r["n"] for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    for source, wanted in (("a", 500), ("b", 500), ("c", 1000)):
        assert wanted - 60 <= used[source] <= wanted


@pytest.mark.parametrize("bins", [2, 4])
def test_the_bin_of_the_cut_is_split_again(spark, monkeypatch, bins):
    docs = [(i, "ab"[i % 2], "words and more " * (1 + i % 7)) for i in range(200)]
    targets = [("a", 1.0, 3), ("b", 2.0, 3)]
    wanted = sorted(map(tuple, mix(spark, docs, targets, total_tokens=900)[0].collect()))
    monkeypatch.setattr(M, "BINS", bins)
    assert sorted(map(tuple, mix(spark, docs, targets, total_tokens=900)[0].collect())) == wanted and wanted


def test_empty_mixtures(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0].isEmpty() and mix(spark, [(1, "a", "x")], [])[0].isEmpty() and mix(spark, [(1, "a", "x")], [("a", 0.0, 1)])[0].isEmpty()


# encodings

CLEAN = ["Für die Prüfung können wir täglich über Größe reden", "La révision empêche déjà l’équipe à préférer été", "评审 拒绝了 草稿， 因为 索引链接 缺少 夜间的 证据。", "Служба потеряла несколько записей после обновления", "A naïve “café” reading — it’s 24 € ± 3…"]


def garble(text, wrong, right="utf-8"):
    raw = text.encode(right)
    return "".join(bytes((b,)).decode(wrong, "replace") if wrong != "cp1252" or bytes((b,)).decode("cp1252", "replace") != "�" else chr(b) for b in raw) if wrong != "gbk" else raw.decode("gbk", "replace")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")


def test_garbled_texts_are_found_and_restored(spark):
    base = [t for t in CLEAN for _ in range(6)]
    wrong = [garble(CLEAN[0], "cp1252"), garble(CLEAN[1], "cp1250"), garble(CLEAN[4], "mac_roman"), garble(CLEAN[0], "cp437"), garble(CLEAN[2], "cp1252"), garble(CLEAN[2], "cp1252", "gbk"), garble(CLEAN[3], "cp1251"), garble(CLEAN[3], "cp1252", "cp1251"), garble(garble(CLEAN[1], "cp1252"), "cp1252")]
    wanted = [CLEAN[0], CLEAN[1], CLEAN[4], CLEAN[0], CLEAN[2], CLEAN[2], CLEAN[3], CLEAN[3], CLEAN[1]]
    rows = {r["doc_id"]: r for r in E.garbled_documents(documents(spark, base + wrong), restore=True).collect()}
    assert set(rows) == set(range(len(base), len(base) + len(wrong)))
    exact = sum(rows[len(base) + i]["text"] == w for i, w in enumerate(wanted))
    assert exact >= len(wanted) - 1, [rows[len(base) + i]["text"] for i in range(len(wanted))]


SENTENCES = [
    "Служба {} потеряла {} записей после обновления",
    "Проверьте файл {} прежде чем удалит {} строк",
    "Отчёт {} показал {} пустых ответов",
    "评审 拒绝了 草稿 {} ， 缺少 证据 {} 。",
    "La révision {} empêche déjà l’équipe, été {}",
    "Für die Prüfung {} können wir täglich {} Größen ändern",
    "src\n├── {}\n└── {}",
]


def planted(pairs, times=4, clean=60, seed=11):
    """Clean sentences with names and numbers of their own, and some garbled by each pair: (texts, which are garbled)."""
    rng = random.Random(seed)
    fill = lambda t: t.format(f"w{rng.randint(0, 999)}-name", rng.randint(1, 9999))
    texts = [(fill(t), None) for t in SENTENCES for _ in range(clean)]
    for read, written in pairs:
        able = []
        for t in SENTENCES:
            try:
                t.encode(written)
            except UnicodeError:
                continue
            if not (t[0] > "\u2e80" and written == "cp1251"):
                able.append(t)
        for t in able:
            for _ in range(times):
                original = fill(t)
                if written in ("cp1251", "koi8-r") and not "\u0400" <= t[0] <= "\u04ff" or written == "gbk" and not (t[0] > "\u2e80" or "├" in t):
                    continue
                texts.append((garble(original, read, written), original))
    return texts


@pytest.mark.parametrize("pairs", [[("cp1252", "utf-8"), ("cp1251", "koi8-r")], [("cp437", "utf-8"), ("cp1252", "gbk")], [("cp1250", "utf-8"), ("cp866", "utf-8"), ("cp1252", "cp1251")]])
def test_mappings_are_learned_by_alignment(spark, pairs):
    texts = planted(pairs)
    docs = documents(spark, [t for t, _ in texts])
    found = {(r, w) for r, w, _ in E.mappings(E.twins(E.lexicon(docs)))}
    assert found == set(pairs), found
    rows = {r["doc_id"]: r["text"] for r in E.garbled_documents(docs, restore=True).collect()}
    assert set(rows) == {i for i, (t, o) in enumerate(texts) if o is not None and t != o}
    assert {(rows[i], o) for i, (t, o) in enumerate(texts) if i in rows and rows[i] != o and "�" not in t} == set()


def test_no_mapping_without_twins(spark):
    texts = planted([("cp1252", "utf-8")], times=3, clean=0)
    assert E.mappings(E.twins(E.lexicon(documents(spark, [t for t, _ in texts])))) == []


def test_alignment_of_one_word():
    assert ("utf-8", "cp1252") in {(w, r) for w, names in E.explained("fÃ¼r", "für") for r in names.split("|")}
    assert {w for w, _ in E.explained("père", "pére")} == set() and not list(E.explained("für", "für-"))
    assert list(E.explained("f�r", "für")) == [("cp1252", "utf-8")]


def test_meant_signs_are_not_garbled(spark):
    meant = ["ATENÇÃO: NÃO apagar", "√ x ≤ 236 µs, Âge™ 24 €", "src\n├── a\n└── b", "GRÖSSE ÄNDERN ÜBER", "“Gemäß” É”, «é »", "plain ASCII", "", None]
    assert E.garbled_documents(documents(spark, [t for t in CLEAN for _ in range(4)] + meant)).isEmpty()


def test_lost_characters_are_found_and_looked_up(spark):
    lost = CLEAN[0].encode("latin-1").decode("utf-8", "replace")
    base = documents(spark, [CLEAN[0]] * 3 + [lost, "x\x9fy", None])
    restored = E.garbled_documents(base, restore=True)
    assert {r["doc_id"] for r in restored.collect()} == {3, 4}
    twins = {r["lost_word"]: r["word"] for r in E.lost_words(restored, E.lexicon(base)).collect()}
    assert twins["F�r"] == "Für" and twins["k�nnen"] == "können"


def test_encoding_edge_cases(spark):
    assert E.garbled_documents(documents(spark, [])).isEmpty()
    clean = "Prüfung täglich für Größe"
    long = "word " * 100_000 + garble(clean, "cp1252")
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), *((i, clean) for i in range(2, 9))], "doc_id bigint, text string")
    assert sorted([r[0] for r in E.garbled_documents(rows).collect()], key=str) == [1, 1, None]
