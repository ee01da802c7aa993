"""The training-data operators against brute force, exact round trips and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shelfspark.llm import bpe, chat, core, jaccard, langid, lines, packing, quality, repeats, tiff

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, texts, ids=None, parts=3):
    rows = [(i if ids is None else ids[i], t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Real rows, and hard ones: nulls, empties, repeats, one word, copies with changes, shared passages."""
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    passage, long = prose(1, 60), prose(2, 300)
    changed = long.split()
    changed[40] = "other"
    extra = [None, "", "  \n\t ", "one", "one", "a b c", "A b C", "x " * 200, long, " ".join(changed), long.replace("w", "W"), passage, prose(3, 30) + " " + passage + " " + prose(4, 9), prose(5, 44) + "\n" + passage, passage[:40] + " end", "été İ Σ 日本語 😀 don't <|endoftext|> we'll\x85\xa0x"]
    return base + extra


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


# --- 1 ---------------------------------------------------------------------------------------


def test_bpe_matches_the_library(docs, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in bpe.roundtrip_digests(docs).collect()}
    assert len(got) == len(corpus)
    for i, t in enumerate(corpus):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(spark):
    df = frame(spark, ["a cat", None, ""]).withColumn("n", F.lit(1))
    out = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["a</w> cat</w>", "", ""] and out[0]["n"] == 1
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("token_ids", F.lit(0)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text("abc", max_size=14))
def test_automaton_equals_merging(picks, word):
    vocab, merges = {c: i for i, c in enumerate("abc")}, []
    for x, y in picks:
        names = list(vocab)
        a, b = names[x % len(names)], names[y % len(names)]
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    machine = bpe.MergeAutomaton(vocab, merges)
    assert machine.decode(machine.encode(list(word))) == parts


# --- 2 and 7 ---------------------------------------------------------------------------------


def words(text):
    return WORD.findall(text or "")


def repeated_at(corpus, n):
    where = defaultdict(list)
    for d, t in enumerate(corpus):
        w = words(t)
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((d, i))
    return [p for p in where.values() if len(p) > 1]


def flags(corpus, places, n):
    out = [[False] * len(words(t)) for t in corpus]
    for d, i in places:
        out[d][i : i + n] = [True] * n
    return out


def test_substring_dedup_is_brute_force(docs, corpus):
    gone = flags(corpus, [p for group in repeated_at(corpus, 35) for p in group], 35)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, with_text=True).collect()}
    assert len(got) == len(corpus)
    for d, t in enumerate(corpus):
        kept = " ".join(w for w, g in zip(words(t), gone[d]) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept"]) == (len(words(t)), sum(gone[d]), kept)
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_short_windows(spark, window):
    texts = ["a b a b a", "b a", "c", None, "d d d", "e f g h i j", "f g h i"]
    gone = flags(texts, [p for group in repeated_at(texts, window) for p in group], window)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(frame(spark, texts), window).collect()}
    assert got == {d: sum(g) for d, g in enumerate(gone)}


def test_passages_are_brute_force(docs, corpus):
    expected = flags(corpus, [p for group in repeated_at(corpus, 50) for p in group], 50)
    got = [[False] * len(words(t)) for t in corpus]
    for r in repeats.passages(docs).collect():
        assert not any(got[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]])
        got[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]] = [True] * r["n_words"]
        assert WORD.findall(r["text"]) == words(corpus[r["doc_id"]])[r["start_word"] : r["start_word"] + r["n_words"]]
    assert got == expected


def test_dropping_passages_keeps_each_once(spark):
    p = prose(9, 80)
    texts = [prose(10, 20) + " " + p, p + "\n" + prose(11, 20), prose(12, 60), None, "", p]
    out = {r["doc_id"]: r["text"] for r in repeats.drop_passages(frame(spark, texts, parts=1)).collect()}
    assert sum(p in (t or "") for t in out.values()) == 1
    assert out[2] == texts[2] and out[3] is None and out[4] == ""
    left = repeats.passages(spark.createDataFrame([(d, t) for d, t in out.items()], "doc_id long, text string")).count()
    assert left == 0


# --- 3 ---------------------------------------------------------------------------------------


def brute_components(corpus, size, percent):
    sets = []
    for t in corpus:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_is_brute_force(docs, corpus, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, size, percent).collect()}
    assert got == brute_components(corpus, size, percent)


def test_jaccard_chains_and_shared_passages(spark):
    """Chains of small changes, whose ends are not similar, and many texts that share one long passage."""
    texts, now = [], prose(20, 80).split()
    for k in range(25):
        now = now[:]
        now[(7 * k) % 80] = f"new{k}"
        texts.append(" ".join(now))
    common = prose(21, 60)
    texts += [common + " " + prose(30 + k, 12 + k % 7) for k in range(40)]
    texts += [common + " " + prose(30 + k, 12 + k % 7) + " tail" for k in range(0, 40, 3)]
    for size, percent in ((4, 85), (3, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, texts), size, percent).collect()}
        assert got == brute_components(texts, size, percent)


def test_signature_bounds_overlap():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (set(rng.integers(0, 3000, rng.integers(1, 900)).tolist()) for _ in range(2))
        x, y = (np.frombuffer(jaccard.signature(core.mix64(np.array(sorted(s), np.uint64))), np.uint8) for s in (a, b))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert len(a & b) <= (len(a) + len(b) - differ) // 2


# --- 4 ---------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1000 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98


def test_language_undecided(spark):
    training = {"en": ["the cat and the dog"], "de": ["der Hund und die Katze"]}
    got = [(r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, ["the dog", "und die", None, "", "12 .,!", "日本"]), training).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:5]] == ["en", "de", "und", "und", "und"] and got[2][1] == 0
    assert langid.identify(frame(spark, ["x"]), {}).first()["lang_pred"] == "und"


def language_texts(seed, first, n_letters, n):
    """Texts of invented words over letters of their own frequencies."""
    rng = np.random.default_rng(seed)
    letters = [chr(first + k) for k in range(n_letters)]
    words = ["".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(300)]
    return [" ".join(rng.choice(words, 150)) for _ in range(n)]


def test_language_rare_ones_and_scripts():
    """One short text of a language does not spoil the others, and each letter counts in large scripts."""
    own = {"aa": language_texts(1, 97, 20, 24), "bb": language_texts(2, 97, 20, 24), "ja": language_texts(3, 0x4E00, 900, 24), "zh": language_texts(4, 0x4E00, 900, 24)}
    training = {k: v[:16] for k, v in own.items()} | {"rare": ["abcdefghij klmnopqrs"]}
    parser = langid.CrossParser(training)
    for k, texts in own.items():
        assert parser.predict([t[:200] for t in texts[16:]])[0] == [k] * 8


def test_suffix_automaton_is_longest_match():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 60)
    table = langid.suffix_automaton(text, 4)
    joined = "".join(map(str, text))
    for _ in range(30):
        query = rng.integers(0, 4, 25)
        n, i, s = 0, 0, "".join(map(str, query))
        while i < len(s):
            k = 1
            while i + k < len(s) and s[i : i + k + 1] in joined:
                k += 1
            i, n = i + k, n + 1
        assert langid.phrase_counts(query[None].astype(np.uint8), np.array([25]), table)[0] == n


# --- 5 ---------------------------------------------------------------------------------------


def test_packing(docs, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(corpus)))
    for d, own in by_doc.items():
        ids = [*library.encode(corpus[d] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert total / (1024 * len(by_sequence)) > 0.97


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=12))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.pack_histogram(dict(histogram), 64)
    held = Counter()
    for p, n in patterns:
        assert sum(p) <= 64
        for x in p:
            held[x] += n
    assert held == Counter(histogram)
    ranges = defaultdict(list)
    for length, lo, hi, _, _ in packing.slots(patterns):
        ranges[length].append((lo, hi))
    for length, own in ranges.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_packing_ties_and_nothing(spark):
    same = packing.pack(packing.pieces(frame(spark, ["a b"] * 50, ids=[7] * 50))).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in same}) == 50
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0


# --- 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, k, s, dtype=np.uint8) for k, s in ((256, (1, 64)), (3, (300, 64)), (9, (33, 50, 3)), (1, (90, 7)), (256, (120, 64)))]
    for predictor in (False, True):
        for tile in (None, (16, 32)):
            back = list(tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, 100, tile, order)))
            assert [p.number for p in back] == list(range(5))
            assert all((p.pixels.reshape(q.shape) == q).all() for p, q in zip(back, pages))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 3))
def test_byte_codecs(data, kind):
    data = (data * 40)[: [300, 5000, 9000, 20000][kind]]
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_media(docs, corpus, spark):
    got = {r["doc_id"]: r for r in tiff.media_features(docs).collect()}
    for d, t in enumerate(corpus):
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = tiff.store(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    files = spark.createDataFrame([(1, tiff.write_tiff([np.zeros((2, 3), np.uint8)] * 2)), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], r["page"], r["width"]) for r in tiff.read_pages(files).orderBy("page").collect()] == [(1, 0, 3), (1, 1, 3)]
    loop = bytearray(tiff.write_tiff([np.zeros((2, 3), np.uint8)]))
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = loop[4:8]
    with pytest.raises(ValueError):
        list(tiff.read_tiff(bytes(loop)))


# --- 8 ---------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark):
    a, b = prose(50, 40), prose(51, 40)
    near = a.split()
    near[11] = "changed"
    near = " ".join(near)
    texts = [f"{a}\n{b}\nshort line", f"start {prose(52, 9)}\n  {a.upper()} \nshort line", f"{near}\n{prose(53, 30)}", None, "", "\n\n", a, prose(54, 3000)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_lines"] == 3
    assert got[1]["text"] == texts[1].split("\n")[0] + "\nshort line" and got[1]["n_removed"] == 1
    assert got[2]["text"] == texts[2].split("\n")[1]
    assert (got[3]["text"], got[4]["text"], got[5]["text"], got[7]["text"]) == (None, "", "\n\n", texts[7])
    assert got[6]["text"] == "" and got[6]["n_removed"] == 1
    assert set(r["doc_id"] for r in lines.drop_lines(frame(spark, texts)).collect()) == {0, 1, 2, 3, 4, 5, 7}
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_links_are_similar(spark):
    """Every pair that is linked is similar; of lines with one changed word of forty, the share that pigeonholing promises is found."""
    base = [prose(60 + k, 40, 5000) for k in range(30)]
    changed = []
    for k, t in enumerate(base):
        w = t.split()
        w[k] = f"z{k}"
        changed.append(" ".join(w))
    all_lines = lines.lines_of(frame(spark, base + changed))
    groups = lines.line_groups(all_lines)
    found = all_lines.join(groups, "h").select("doc_id", "keep_doc", "norm").collect()
    text = {i: t for i, t in enumerate(base + changed)}
    for r in found:
        assert edit(text[r["doc_id"]], text[r["keep_doc"]]) <= 0.2 * max(len(text[r["doc_id"]]), len(text[r["keep_doc"]]))
    assert sum(r["doc_id"] != r["keep_doc"] for r in found) >= 12


def kept_of(spark, texts):
    """For each text of one line, the id of the text that stays of its group (its own if none was similar)."""
    all_lines = lines.lines_of(frame(spark, texts))
    found = all_lines.join(lines.line_groups(all_lines), "h").select("doc_id", "keep_doc").collect()
    return {i: i for i in range(len(texts))} | {r["doc_id"]: r["keep_doc"] for r in found}


def replaced(text, places):
    w = text.split()
    for k in places:
        w[k] = "zzzz"
    return " ".join(w)


def test_line_links_reach_the_similarity(spark):
    """One changed word of 10, 20 or 40, or four of 40, is found in 27 of 30 lines at least."""
    rng = np.random.default_rng(7)
    base = [prose(300 + k, n, 5000) for n in (10, 20, 40, 40) for k in range(30 * n, 30 * n + 30)]
    base[90:] = [prose(9000 + k, 40, 5000) for k in range(30)]
    changed = [replaced(t, rng.choice(len(t.split()), 4 if i >= 90 else 1, replace=False)) for i, t in enumerate(base)]
    keep = kept_of(spark, base + changed)
    for first in range(0, 120, 30):
        assert sum(keep[120 + i] == i for i in range(first, first + 30)) >= 27
    assert all(keep[i] == i for i in range(120))


def test_long_lines_are_compared(spark):
    """Lines above 255 words, also ones of the next level of lengths, lose their near copies."""
    a, b, c = prose(400, 300, 5000), prose(401, 1200, 5000), prose(402, 3000, 5000)
    longer = c + " " + prose(403, 150, 5000)
    assert kept_of(spark, [a, b, c, replaced(a, [150]), replaced(b, range(0, 1200, 60)), longer]) == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}


def test_short_lines_go(spark):
    """op8 and the pipeline keep one of equal or similar lines however short they are; blank lines stay."""
    texts = ["short line\n\nok", "Short  LINE\n\nother words", "ok\nanother page of text", "another page of texts\nlast"]
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "\nother words", 2: "another page of text", 3: "last"}


# --- 9 ---------------------------------------------------------------------------------------

CONTROL_TEXT = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "\\l", "\n", "user", "<", "[", ""]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROL_TEXT), CONTROL_TEXT), max_size=4))
def test_chat_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for c in chat.CONTROL:
        assert formatted.count(c) == (len(turns) if c in (chat.START, chat.END) else 0)


def test_chat_layouts():
    records = {
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}': [("user", "q"), ("assistant", "a")],
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}': [("user", "q"), ("assistant", "")],
        '{"prompt": "q", "completion": "a"}': [("user", "q"), ("assistant", "a")],
        '{"system": "s", "prompt": "q", "response": "a"}': [("system", "s"), ("user", "q"), ("assistant", "a")],
        '{"instruction": "i", "input": "x", "output": "a", "source": "z"}': [("user", "i\n\nx"), ("assistant", "a")],
        '{"question": "q", "answer": "a"}': [("user", "q"), ("assistant", "a")],
        '{"messages": []}': [],
    }
    for record, turns in records.items():
        assert chat.canonical(record)[1] == turns
    assert all(chat.canonical(x) == (None, None) for x in (None, "", "[1]", "{", '{"other": 1}'))


def test_chat_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = defaultdict(list)
    for r in sorted(table, key=lambda r: (r["conv_id"], r["turn"])):
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    probe = "</s>[INST] ok [/INST]"
    convs[-1] = [("user", probe), ("assistant", probe)]
    got = {r["conv_id"]: r for r in chat.op9_chat_format(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_records_with_nulls(spark):
    rows = [(1, 0, None, "a"), (1, 0, None, "a"), (1, None, "user", None), (None, 1, "user", "x")]
    out = chat.digests(chat.format_records(chat.records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert {r["conv_id"]: r["n_turns"] for r in out} == {1: 3, None: 1}


# --- 10 --------------------------------------------------------------------------------------


def test_quality_statistics(docs, corpus):
    got = {r["doc_id"]: r for r in quality.verdicts(quality.statistics(docs)).collect()}
    assert len(got) == len(corpus)
    for d, t in enumerate(corpus):
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_texts_are_broadcast_by_their_bytes(spark, monkeypatch):
    """Few rows with much text are joined by a shuffle, with the same rows."""
    shared = prose(90, 80)
    docs = frame(spark, [f"{prose(91 + k, 70)} {shared}" for k in range(4)] + [None, ""])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark's own choice for small files
    wide = repeats.drop_passages(docs)
    assert "BroadcastHashJoin" in wide._jdf.queryExecution().simpleString()
    monkeypatch.setattr(core, "BROADCAST_BYTES", 10)
    dealt = repeats.drop_passages(docs)
    assert "BroadcastHashJoin" not in dealt._jdf.queryExecution().simpleString()
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, wide.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_similarity_is_the_edit_distance(spark):
    """The bound by replaced words and the cut at equal ends must not change which lines are similar."""
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        words = [rng.choice(["a", "bb", "ccc", "né", "eeeee"]) for _ in range(rng.randint(1, 12))]
        other = list(words)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 2)] = rng.choices(["a", "bb", "xyz"], k=rng.randint(0, 2))
        rows.append((" ".join(words), " ".join(other or ["a"])))
    pairs = spark.createDataFrame(rows, "x string, y string")
    got = pairs.select("x", "y", lines._similar(F.col("x"), F.col("y")).alias("similar"), F.levenshtein("x", "y").alias("d")).collect()
    assert all(r["similar"] == (r["d"] <= int(0.2 * max(len(r["x"]), len(r["y"])) + 1e-9)) for r in got)
    assert 50 < sum(r["similar"] for r in got) < 350


def test_quality_line_frequency(spark):
    notice = "Please accept all 12 cookies"
    texts = [prose(100 + k, 60) + f"\n{notice}" for k in range(12)] + ["\n".join([f"please  accept all 99 COOKIES"] * 15 + [f"only{k}"]) for k in range(3)] + [None, ""]
    found = quality.verdicts(quality.statistics(frame(spark, texts, parts=1)), line_docs=5, line_share=0.1)
    got = {r["doc_id"]: (r["kept"], r["n_removed_words"]) for r in found.collect()}
    assert got[0] == (True, 0) and all(got[k] == (True, 5) for k in range(1, 12))
    kept = {r["doc_id"]: r["text"] for r in quality.quality_filter(frame(spark, texts, parts=1), 5, 0.1).collect()}
    assert set(kept) == set(range(12)) and kept[0] == texts[0] and kept[3] == texts[3].split("\n")[0]


# --- shared ----------------------------------------------------------------------------------


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["component"] for r in core.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20} | {k: 100 for k in range(100, 141)}
    assert core.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_and_null_tables(spark):
    for texts in ([], [None], [""], [None, None]):
        df = frame(spark, texts)
        n = len(texts)
        assert repeats.remove_repeats(df).count() == n and repeats.passages(df).count() == 0
        assert jaccard.jaccard_components(df).count() == n
        assert quality.verdicts(quality.statistics(df)).count() == n
        assert tiff.media_features(df).count() == n and bpe.roundtrip_digests(df).count() == n
    nameless = spark.createDataFrame([(None, "a b", None, None, None), (None, "a b", None, None, None)], SCHEMA)
    assert [r["component_id"] for r in jaccard.jaccard_components(nameless).collect()] == [None, None]
    assert repeats.drop_passages(nameless).count() == 2 and lines.dedup_lines(nameless).count() == 2 and quality.quality_filter(nameless).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, n = docs, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        assert before.columns == docs.columns, name
        assert 0 < before.count() <= n
        assert before.select("doc_id").distinct().count() == before.count()
        n = before.count()
    assert jaccard.jaccard_components(before, 5, 80).where("component_id <> doc_id").count() == 0
    assert repeats.passages(before).count() == 0
    pieces = corpus_pipeline.packing_stage(spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == n


def test_guarded_entry():
    source = (Path(core.__file__).parent / "../../__spark_entry__.py").resolve().read_text()
    assert "except ImportError" in source
