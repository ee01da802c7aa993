"""Edges of the training-data operators: texts that cancel out in sums, brute-force verdicts and packs, broken records and files, clashing columns, very long texts."""

import hashlib
import json
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import bpe, chat, core, jaccard, langid, lines, packing, quality, repeats, tiff

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(parts, "doc_id")


def thue_morse(bits, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1 << bits))


def prose(seed, n, size=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- texts that cancel out modulo 2**64 ------------------------------------------------------


def test_hashes_tell_cancelling_texts_apart():
    one, two = thue_morse(10), thue_morse(10, "b", "a")
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    h = core.Words(data, np.array([0, len(data)])).hashes()
    assert h[0] != h[1] and h[0] == h[2]
    codes = core.mix64(np.arange(2, dtype=np.uint64))[[int(c == "b") for c in thue_morse(11) + thue_morse(11, "b", "a")]]
    n = 1 << 11
    assert len(set(core.sequence_hashes(codes, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    assert len(set(core.window_hashes(codes, np.array([0, n]), n).tolist())) == 2


def test_hashes_are_equal_for_equal_spans():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 100, k, dtype=np.uint8)) for k in (0, 1, 7, 8, 9, 16, 500, 4096, 4097, 9000)]
    data = np.frombuffer(b"".join(parts) + b"zz" + b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    shift = int(sizes.sum()) + 2
    h = core.byte_hashes(data, np.concatenate([starts, starts + shift]), np.concatenate([starts + sizes, starts + sizes + shift]))
    assert (h[: len(parts)] == h[len(parts) :]).all() and len(set(h.tolist())) == len(parts)


def test_operators_tell_cancelling_texts_apart(spark):
    one, two = thue_morse(10), thue_morse(10, "b", "a")
    shared = prose(1, 34)
    got = repeats.remove_repeats(frame(spark, [f"{shared} {one}", f"{shared} {two}"])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    assert sorted(r["component_id"] for r in jaccard.jaccard_components(frame(spark, [one, two]), 4, 85).collect()) == [0, 1]
    lines_of_4096 = [thue_morse(12), thue_morse(12, "b", "a")]
    row = quality.verdicts(quality.statistics(frame(spark, ["\n".join(lines_of_4096)]))).first()
    assert row["n_dup_lines"] == 0
    left = prose(2, 49)
    assert repeats.passages(frame(spark, [f"{left} {one}", f"{left} {two}"])).count() == 0
    found = lines.lines_of(frame(spark, lines_of_4096), 1).select("h", "g").distinct()
    assert found.count() == 2 and found.select("h").distinct().count() == 2


# --- packing ---------------------------------------------------------------------------------


def one_by_one(histogram, room):
    """Each piece, longest first, into the open pack with the most room, of equal ones the least pattern; else into a new one."""
    packs = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        best = max(packs, key=lambda p: room - sum(p), default=None)
        if best is None or room - sum(best) < length:
            packs.append([length])
        else:
            most = room - sum(best)
            min((p for p in packs if room - sum(p) == most), key=tuple).append(length)
    return Counter(map(tuple, packs))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 12), max_size=8))
def test_packs_are_those_of_single_pieces(histogram):
    assert Counter({p: n for p, n in packing.pack_histogram(dict(histogram), 32)}) == one_by_one(histogram, 32)


def test_shortest_pack_comes_first():
    assert sorted(packing.pack_histogram({15: 1, 12: 1, 5: 1}, 20)) == [((12, 5), 1), ((15,), 1)]


def test_ranks_with_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    rows = packing.pack(packing.pieces(frame(spark, ["same words"] * 50 + [prose(5, 1500)] * 3))).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024


# --- quality ---------------------------------------------------------------------------------


def brute_verdicts(docs, keep_first):
    """kept and removed words by plain Python over (doc_id, text, source)."""
    spaces = "[\x20\x09-\x0d]+"
    folded, hosts, first = {}, Counter(), {}
    counts = Counter()
    for d, t, s in sorted(docs, key=lambda x: x[0]):
        hosts[s] += 1
        own = []
        for at, line in enumerate((t or "").split("\n")):
            words = [w for w in re.split(spaces, line) if w]
            if words:
                key = tuple(re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in words)
                own.append((at, key))
        folded[d] = own
        for key in {k for _, k in own}:
            counts[s, key] += 1
            first.setdefault((s, key), d)
    out = {}
    for d, t, s in docs:
        words = [w for w in re.split(spaces, t or "") if w]
        limit = min(quality.LINE_DOCS, max(quality.LEAST_DOCS - 1, quality.LINE_SHARE * hosts[s]))
        lost = sum(len(k) for _, k in folded[d] if counts[s, k] > limit and not (keep_first and first[s, k] == d))
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out[d] = (not base and lost <= quality.DEPLETED * len(words), lost)
    return out


@pytest.mark.parametrize("keep_first", [True, False])
def test_quality_verdicts_are_brute_force(spark, keep_first):
    """On the whole test table; the method rejects documents there that the base rules let pass."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"] or "") for r in table.collect()]
    assert len({d for d, _, _ in rows}) == len(rows)
    got = {r["doc_id"]: r for r in quality.verdicts(quality.statistics(table), keep_first=keep_first).collect()}
    expected = brute_verdicts(rows, keep_first)
    assert {d: (r["kept"], r["n_removed_words"]) for d, r in got.items()} == expected
    if not keep_first:
        assert any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_copies_are_documents(spark):
    """Equal texts of one host count one by one, so their shared line goes."""
    text = prose(9, 60) + "\nAccept all cookies"
    got = quality.verdicts(quality.statistics(frame(spark, [text] * 30 + [prose(k, 60) for k in range(20, 50)])), keep_first=False)
    assert got.where("doc_id < 30 and n_removed_words > 0").count() == 30


# --- broken records and files ----------------------------------------------------------------

BROKEN = [
    '{"messages":5}', '{"messages":"abc"}', '{"messages":["x",{"role":"a","content":"b"}]}', '{"messages":[{"role":"a","content":"b"},{"role":"c"}]}', '{"messages":[{"role":"a","content":5}]}',
    '{"conversations":[{"from":"a","value":"b"}],"system":5}', "[" * 100_000, '{"a":' * 50_000, "{", "null", "5", "", '{"messages":[{"role":"a","content":"\\ud800"}]}', '{"prompt":3,"response":"x"}', '{"messages":[{"role":["x"],"content":"b"}]}',
]


def test_broken_records_have_no_layout(spark):
    df = spark.createDataFrame([*enumerate(BROKEN), (99, None)], "conv_id long, record string")
    rows = chat.format_records(df).collect()
    assert len(rows) == len(BROKEN) + 1
    assert all(r["layout"] is None and r["formatted"] is None and r["loss_spans"] == [] for r in rows)
    assert chat.digests(chat.format_records(df)).where("n_turns <> 0").count() == 0
    assert chat.format_records(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["messages", "role", "content", "prompt", "response", "system", "conversations", "from", "value", "input", "instruction", "output"]), x, max_size=4), max_leaves=8))
def test_any_record_has_a_result(value):
    layout, turns = chat.canonical(json.dumps(value))
    assert (layout is None) == (turns is None)
    if turns is not None:
        assert chat.parse(chat.render(turns)[0]) == turns


def test_several_layouts_come_from_one_table(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "a"), (2, 2, "assistant", None), (3, 0, "user", "x"), (4, 0, "tool", "x"), (4, 1, "user", None), (5, 0, "system", None), (5, 1, "user", "u"), (5, 2, "assistant", "v"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_records(chat.records(turns))
    got = {r["conv_id"]: (r["layout"], chat.parse(r["formatted"])) for r in formatted.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "prompt and response", 2: "instruction", 3: "conversations", 4: "messages", 5: "conversations", None: "conversations"}
    for conv in got:
        assert got[conv][1] == [(role or "", text or "") for c, _, role, text in rows if c == conv]


def test_broken_files_are_error_rows(spark):
    good = tiff.write_tiff([np.zeros((2, 3), np.uint8)] * 2)
    cut = good[: len(good) - 9]
    huge = bytearray(good)
    at = struct.unpack_from("<I", huge, 4)[0]
    struct.pack_into("<I", huge, at + 2 + 8, 1 << 31)  # the width, as the first tag's value
    missing = tiff.write_tiff([np.zeros((600, 64), np.uint8)])
    df = spark.createDataFrame([(1, good), (2, cut), (3, b"no tiff"), (4, b""), (5, bytes(huge)), (6, None), (7, missing[:200]), (8, b"II*\0")], "doc_id long, media binary")
    rows = tiff.read_pages(df).collect()
    assert [r["page"] for r in rows if r["doc_id"] == 1] == [0, 1] and all(r["error"] is None for r in rows if r["doc_id"] == 1)
    for doc in (2, 3, 4, 5, 7, 8):
        assert [r["error"] is not None for r in rows if r["doc_id"] == doc][-1], doc
    assert not [r for r in rows if r["doc_id"] == 6]


def test_payloads_take_all_forms():
    seen = set()
    for k in range(200):
        data, n = tiff.payload(prose(k, 40 + k))
        pages = list(tiff.read_tiff(tiff.store(data)))
        assert b"".join(p.pixels.tobytes() for p in pages) == data
        seen.add((pages[0].compression, pages[0].predictor, pages[0].tiled))
    assert {c for c, _, _ in seen} == {tiff.PACKBITS, tiff.LZW, tiff.DEFLATE} and {t for _, _, t in seen} == {True, False}


# --- clashing columns, empty tables, very long texts -----------------------------------------


def test_clashing_columns(spark):
    names = ["_id", "_hash", "_text", "_removed", "_kept", "_host", "_changed", "n_lines", "n_removed", "rank", "salt", "component_id", "h", "__id"]
    base = frame(spark, [f"{prose(1, 60)}\nsame line of the host here", f"{prose(2, 60)}\nsame line of the host here", prose(1, 60), prose(3, 70), None, ""])
    docs = base.select("*", *(F.lit(f"{n}!").alias(n) for n in names))
    for stage in (quality.quality_filter, lines.drop_lines, repeats.drop_passages, jaccard.drop_near_duplicates):
        out = stage(docs)
        assert out.columns == docs.columns
        rows, plain = out.collect(), stage(base).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in plain)
        assert all(r[n] == f"{n}!" for r in rows for n in names)
    out = lines.dedup_lines(docs)
    assert out.columns.count("n_lines") == 1 and dict(out.dtypes)["n_lines"] == "bigint"


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.roundtrip_digests(none).count() == 0 and tiff.media_features(none).count() == 0
    for stage in (quality.quality_filter, lines.drop_lines, repeats.drop_passages, jaccard.drop_near_duplicates):
        assert stage(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_records(chat.records(turns))).count() == 0
    assert langid.identify(none, {"en": [prose(1, 30)], "de": ["ein Text"]}).count() == 0
    assert [tuple(r)[1:] for r in langid.identify(frame(spark, ["some text", None]), {}).collect()] == [("und", 0.0)] * 2


def test_very_long_texts(spark):
    """One text of 20 MB among short ones, in the operators that look at whole texts."""
    rng = np.random.default_rng(2)
    words = np.char.add("w", rng.integers(0, 300_000, 2_600_000).astype(str))
    long = " ".join(words.tolist())
    passage = prose(77, 60)
    docs = frame(spark, [f"{long} {passage}", f"{passage} end", "short", None], parts=2)
    assert {r["doc_id"]: r["n_words"] for r in repeats.remove_repeats(docs).collect()} == {0: 2_600_060, 1: 61, 2: 1, 3: 0}
    spans = {(r["doc_id"], r["n_words"]) for r in repeats.passages(docs).collect()}
    assert spans == {(0, 60), (1, 60)}
    row = {r["doc_id"]: r for r in quality.verdicts(quality.statistics(docs)).collect()}[0]
    assert row["n_words"] == 2_600_060 and row["word_chars"] == sum(map(len, words.tolist())) + len(passage.replace(" ", ""))
    media = {r["doc_id"]: r for r in tiff.media_features(docs).collect()}[0]
    assert media["payload_sha256"] == hashlib.sha256(tiff.payload(f"{long} {passage}")[0]).hexdigest()
    assert jaccard.jaccard_components(docs, 4, 85).where("component_id <> doc_id").count() == 0


# --- suffixes --------------------------------------------------------------------------------


def brute_passages(texts, n):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((d, i))
    covered = set()
    for at in places.values():
        if len(at) > 1:
            covered |= {(d, i + k) for d, i in at for k in range(n)}
    return covered


@pytest.mark.parametrize(("hot", "n"), [(20_000, 50), (2, 50), (2, 20), (0, 17), (20_000, 9)])
def test_passages_with_hot_heads_are_brute_force(spark, monkeypatch, hot, n):
    """Suffixes dealt by more words find the same passages."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(hot + n)
    shared = [prose(500 + k, rng.randint(n - 2, n + 30)) for k in range(6)]
    texts = []
    for k in range(30):
        parts = [prose(1000 + k * 7 + j, rng.randint(0, 12)) for j in range(3)]
        texts.append(" ".join([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]]))
    texts += ["a b " * 80, "a b " * 60, texts[0], None, ""]
    # A neighbour in sorted order that matches farther to the right must not hide one that matches to the left.
    left, head, right = prose(1, 40), prose(2, 16), prose(3, 40)
    texts += [f"{left} {head} x1", f"{left} {head} x2", f"{prose(4, 20)} {head} {right}", f"{prose(5, 20)} {head} {right}"]
    got = set()
    for r in repeats.passages(frame(spark, texts), n).collect():
        got |= {(r["doc_id"], r["start_word"] + k) for k in range(r["n_words"])}
    assert got == brute_passages(texts, n)


# --- SQL and brute force over whole tables ---------------------------------------------------


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op7_substring_dedup", "op9_chat_format", "op10_quality_rules"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from shelfspark.llm import queries

    small = SF.replace("0.01", "0.001")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    expected = con.sql(queries.SQL[name]).select(*columns).fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, expected)) and expected


def test_line_groups_against_all_pairs(spark):
    """Over every pair of different lines of the smallest table: no pair in one group without a chain of similar ones, nine of ten similar pairs in one group."""
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet")
    all_lines = lines.lines_of(docs, 1)
    one = all_lines.select("h", "norm").dropDuplicates(["h"]).withColumn("n", F.length("norm"))
    limit = F.floor(0.2 * F.greatest("n", "m") + 1e-9).cast("int")
    other = one.select(F.col("h").alias("o"), F.col("norm").alias("other"), F.col("n").alias("m"))
    pairs = one.repartition(16).join(F.broadcast(other), (F.col("h") < F.col("o")) & (F.abs(F.col("n") - F.col("m")) <= 0.2 * F.greatest("n", "m") + 1e-9))
    similar = [(r["h"], r["o"], r["n"]) for r in pairs.where(F.call_function("levenshtein", F.col("norm"), F.col("other"), limit) >= 0).select("h", "o", "n").collect()]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in similar:
        parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in lines.similar_lines(lines.distinct_lines(all_lines)).collect()}
    members = defaultdict(set)
    for node, component in got.items():
        members[component].add(find(node))
    assert all(len(m) == 1 for m in members.values())
    met = [got.get(a, a) == got.get(b, b) for a, b, _ in similar]
    by_length = {name: (sum(m for m, (_, _, n) in zip(met, similar) if lo <= n < hi), sum(lo <= n < hi for _, _, n in similar)) for name, lo, hi in (("short", 0, 40), ("middle", 40, 200), ("long", 200, 10**9))}
    print(by_length)
    assert len(similar) >= 20 and sum(met) >= 0.9 * len(met), by_length


def test_similar_lines_of_a_large_block_of_strangers(spark):
    """Two lines that share only runs which many others have, none of them similar: no pivot stands for them."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = [" ".join(word(9) for _ in range(3)) for _ in range(4)]
    held = lambda n: " ".join(f"{c} {word(n)}" for c in common)
    strangers = [" ".join(f"{c} {' '.join(word(9) for _ in range(9))}" for c in common) for _ in range(300)]
    texts = [*strangers[:150], held(3), held(3), *strangers[150:]]
    all_lines = lines.lines_of(frame(spark, texts), 1)
    groups = all_lines.join(lines.line_groups(all_lines), ["h", "g"]).select("doc_id", "keep_doc").collect()
    assert {(r["doc_id"], r["keep_doc"]) for r in groups} == {(150, 150), (151, 150)}


def test_line_dedup_keeps_no_table_of_all_lines_beside_the_comparison(spark, monkeypatch):
    """While lines are compared only the distinct ones lie on disk; blocks of features go once their members are written."""
    seen, compared, verified = [], lines.similar_lines, lines._verified

    def watched(distinct):
        seen.extend(core._written())
        return compared(distinct)

    def checked(pairs, distinct):
        assert not any("/line-features-" in p for p in core._written())
        return verified(pairs, distinct)

    monkeypatch.setattr(lines, "similar_lines", watched)
    monkeypatch.setattr(lines, "_verified", checked)
    mark = core.written()
    removed = lines.removed_lines(frame(spark, ["one two three four five six\nunlike", "one two three four five six\nother text here"]), 1).collect()
    assert [(r["doc_id"], r["removed"]) for r in removed] == [(1, [0])]
    assert any("/distinct-lines-" in p for p in seen[mark:]) and not any("/lines-" in p for p in seen[mark:])


def test_strays_of_few_words_leave_the_join_only_if_similar(spark):
    """Strangers of few words look alike to SimHashes; a block of them gives no pairs to compare that grow with its square."""
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    some = lambda: ["".join(rng.choices(syllables, k=rng.choice([1, 2, 3]))) for _ in range(3)]
    texts = sorted({" ".join([*some(), "tion", *some()]) for _ in range(200)})
    texts += [texts[0] + "x", texts[-1] + "x"]
    distinct = lines.distinct_lines(lines.split_lines(frame(spark, texts), 1))
    made = distinct.select("h", "chars", lines._features(F.col("norm")).alias("f")).select("h", "chars", "f.words", "f.bits.s0", "f.bits.s1")
    members = made.select(F.lit(1).cast("long").alias("block"), "*", F.lit(len(texts)).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("pivots"))
    names = distinct.select("h", "norm")
    found = lines._strays(members, spark.createDataFrame([], "node long, component long"), distinct)
    got = found.join(names.withColumnsRenamed({"h": "a", "norm": "x"}), "a").join(names.withColumnsRenamed({"h": "b", "norm": "y"}), "b").collect()
    pairs = {tuple(sorted([r["x"], r["y"]])) for r in got}
    distance = {(r["x"], r["y"]): r["d"] for r in spark.createDataFrame(list(pairs), "x string, y string").select("x", "y", F.levenshtein("x", "y").alias("d")).collect()}
    assert {(texts[0], texts[-2]), (texts[-3], texts[-1])} <= pairs
    assert all(d <= max(map(len, p)) // 5 for p, d in distance.items())


@pytest.mark.parametrize(("whole", "tile"), [(256, 2048), (20, 16)])
def test_strays_leave_the_join_only_if_similar(spark, monkeypatch, whole, tile):
    """Near copies below the similarity give no pairs to compare that grow with their square; similar ones that share several blocks come out once."""
    monkeypatch.setattr(lines, "WHOLE", whole, raising=False)
    monkeypatch.setattr(lines, "TILE", tile)
    rng = random.Random(6)
    base = prose(91, 30, 5000).split()
    texts = sorted({" ".join(w if rng.random() > rng.choice([0.1, 0.3]) else prose(rng.randrange(10**6), 1, 5000) for w in base) for _ in range(90)})
    distinct = lines.distinct_lines(lines.split_lines(frame(spark, texts), 1))
    made = distinct.select("h", "chars", lines._features(F.col("norm")).alias("f")).select("h", "chars", "f.words", "f.bits.s0", "f.bits.s1")
    shared = [(b, part) for b, part in ((1, 0), (2, 0), (2, 1), (3, 1), (4, 0), (4, 1))]  # lines by the parity of their hash
    blocks = spark.createDataFrame(shared, "block long, part long")
    members = made.withColumn("part", F.pmod("h", F.lit(2))).join(F.broadcast(blocks), "part").drop("part")
    members = members.select("block", "h", *lines._TRAITS, F.lit(len(texts)).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("pivots"))
    found = lines._strays(members, spark.createDataFrame([], "node long, component long"), distinct).collect()
    rows = {r["h"]: r for r in made.join(distinct.select("h", "norm"), "h").collect()}
    differ = lambda x, y: sum(((x[s] ^ y[s]) & (1 << 64) - 1).bit_count() for s in ("s0", "s1"))
    pairs = [(a, b) for a in rows for b in rows if a < b and differ(rows[a], rows[b]) <= lines.WORD_BITS]
    texts_of = spark.createDataFrame([(a, b, rows[a]["norm"], rows[b]["norm"]) for a, b in pairs], "a long, b long, x string, y string")
    similar = texts_of.where(F.levenshtein("x", "y") <= F.floor(0.2 * F.greatest(F.length("x"), F.length("y")) + 1e-9)).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted((r["a"], r["b"]) for r in similar)
    assert 10 < len(similar) < 0.8 * len(pairs)


def test_couples_lose_no_similar_line_of_few_words(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        x = list("".join(rng.choices("aab é한😀tx ", k=rng.randint(1, 60))))
        y = list(x)
        for _ in range(rng.randint(0, len(x) // 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "é", "한"])
        rows.append(("".join(x), "".join(y)))
    pairs = spark.createDataFrame(rows, "norm string, o_norm string").select("*", F.length("norm").alias("chars"), F.length("o_norm").alias("o_chars"), lines._couples(F.col("norm")).alias("c"), lines._couples(F.col("o_norm")).alias("o_c"))
    pairs = pairs.select("*", *(F.col(f"{o}c")[k].alias(f"{o}c{k}") for o in ("", "o_") for k in range(lines.COUPLES)))
    near = F.levenshtein("norm", "o_norm") <= F.floor(0.2 * F.greatest("chars", "o_chars") + 1e-9)
    got = pairs.select(near.alias("near"), lines._few_similar("o_").alias("got")).collect()
    assert [r["got"] for r in got] == [r["near"] for r in got] and 50 < sum(r["near"] for r in got) < 290


def test_longer_runs_start_at_the_places_of_their_blocks(spark):
    """Hashes of six and of twelve words, or of eight and sixteen characters, agree if the texts do from the block's place on."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"{same} thirteen", f"zero {same}", "one two three four five six seven eight nine ten eleven xii thirteen", "one two three 4 five six seven eight nine"]
    block = lambda norm: lines._keyed(lines._hashed_words(norm), lines.WORD_GRAM, 1)
    one = spark.createDataFrame([(t,) for t in texts], "norm string").withColumn("block", F.lit(block(F.lit("one two three"))[0]))
    got = [r["l"] for r in one.select(lines._longer(F.col("norm"), F.array("block")).alias("l")).collect()]
    assert [len(x) for x in got] == [1, 1, 1, 1]
    a, b, c, d = (x[0]["rest"] for x in got)
    assert a == b and a[0] == c[0] and a[1] != c[1] and a[0] != d[0]


def test_strays_visit_the_classes_of_lengths_in_reach_and_are_shuffled_once(spark, monkeypatch):
    """Similar lengths meet; a stray has two rows as a rule, and both ways of the search for near lines read one shuffle of each table."""
    sizes = spark.range(1, 600).select("id", lines._size(F.col("id")).alias("size"), lines._in_reach(F.col("id")).alias("reach")).collect()
    own = {r["id"]: r["size"] for r in sizes}
    assert all(own[b] in r["reach"] for r in sizes for b in own if min(b, r["id"]) >= 0.8 * max(b, r["id"]) - 1e-9)
    assert sum(len(r["reach"]) for r in sizes) < 2.2 * len(sizes)
    plans, put = [], lines.stash

    def kept(df, name, large=False):
        if name == "stray-lines":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name, large)

    monkeypatch.setattr(lines, "stash", kept)
    monkeypatch.setattr(lines, "WHOLE", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [" ".join(f"w{k}x{j}" for j in range(6 + k % 9)) + " one common tail" for k in range(60)]
        distinct = spark.createDataFrame([(k + 1, 1, 1, len(t), t) for k, t in enumerate(texts)], "h long, g long, copies long, chars int, norm string")
        lines.similar_lines(distinct).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and "ReusedExchange" in plans[0].split("== Initial Plan ==")[0]
