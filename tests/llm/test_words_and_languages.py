"""Spelling groups, token alignment and language filters against brute force and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.llm import alignment, catalog, language, spelling

# --- spelling groups ------------------------------------------------------------------------


def one_apart(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter, letter by letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words, ratio=5):
    found = {}
    for w, n in words.items():
        near = [(-m, x) for x, m in words.items() if one_apart(w, x)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        found[w] = (form, n, len(near), -best[0] if form else None)
    rows = {}
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows[w] = (w, form, root, n, n_near, form_n)
    return rows


def groups_of(spark, words):
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return {r.word: tuple(r) for r in spelling.spelling_groups(frame).collect()}


def test_spelling_groups_equal_all_pairs(spark):
    rng = random.Random(5)
    words = Counter()
    for _ in range(60):
        base = "".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 12)))
        words[base] = rng.choice([5, 25, 125, 700])
        for _ in range(rng.randint(0, 9)):  # chains of slips of slips
            near = list(rng.choice([w for w in words]))
            kind, at = rng.choice("idr"), rng.randrange(len(near))
            near[at:at + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdeéß")]
            words["".join(near)] = rng.choice([1, 1, 5, 5, 30])
    # One half in common by all: the signatures of the whole word have to tell them apart.
    words.update({f"international{x}{y}": 5 + 30 * (x == "a") for x in "abcdefgh" for y in "abcdefgh"})
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "bbbbbb": 3, "abbbbb": 15, "x" * 30_000: 7, "x" * 30_001: 70}
    want = plain_groups(words)
    assert groups_of(spark, words) == want
    assert want["aaaaaa"][2] == "aaaaaaaaa"


def test_every_near_pair_shares_a_signature():
    rng = random.Random(6)
    for _ in range(300):
        a = "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
        b = list(a)
        at = rng.randrange(len(b) + 1)
        b[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        if one_apart(a, b):
            short, long_ = sorted((a, b), key=len)
            own = {k for k, longer in spelling.signature_keys(short) if not longer}
            theirs = {k for k, longer in spelling.signature_keys(long_) if longer == (len(long_) > len(short))}
            assert own & theirs, (a, b)


def test_words_of_the_corpus(spark):
    texts = [None, "", "Hello-WORLDS hello", "Ünder ünder ÜNDER naïveté×é", "short", "straße " * 40, "abcdef" * 5_000, "日本語 letters"] * 3
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    got = {r.word: r.n for r in spelling.corpus_words(spark.createDataFrame(rows, "doc_id bigint, text string, word string"), times=2).collect()}
    want, slipped = Counter(), 0
    letters = {*map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))}
    for doc_id, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run, slipped = run[:h % len(run)] + run[h % len(run) + 1:], slipped + 1
                want[run] += 1
            run = ""
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}


def test_spelling_query(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op11_spelling_groups", catalog.QUERIES["op11_spelling_groups"],
                   catalog.ORACLE["op11_spelling_groups"]) is None


def test_spelling_without_words(spark):
    empty = spark.createDataFrame([], "word string, n bigint, form string")
    assert spelling.spelling_groups(empty).collect() == []
    assert spelling.corpus_words(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    odd = spark.createDataFrame([(None, 5), ("lonely", 5), ("letter", None)], "word string, n bigint")
    assert [tuple(r) for r in spelling.spelling_groups(odd).collect()] == [("lonely", None, "lonely", 5, 0, None)]


# --- alignment ------------------------------------------------------------------------------

def plain_alignment(texts):
    """Every overlap of two tokens, found by comparing all byte ranges that can meet."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: i for i, c in alignment.byte_letters().items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    assert decoders.ByteLevel().decode([a.id_to_token(262)]) == bytes(letters[c] for c in a.id_to_token(262)).decode()
    counts, links, rows = Counter(), [], []
    for text in texts:
        own_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        own_b = [(i, b_bytes(i)) for i in b.encode(text)] if text else []
        whole = f" {text}".encode()
        if not text or b"".join(x for _, x in own_a) != whole or b"".join(x for _, x in own_b) != whole:
            links.append([])
            rows.append([0, 0, 0, ""])
            continue
        spans = []
        for own in (own_a, own_b):
            at, out = 0, []
            for i, x in own:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, i, k = [], 0, 0
        pairs = []
        for end in ends:
            one, two = [], []
            while i < len(spans[0]) and spans[0][i][2] <= end:
                one.append(spans[0][i])
                i += 1
            while k < len(spans[1]) and spans[1][k][2] <= end:
                two.append(spans[1][k])
                k += 1
            groups.append(f"{','.join(str(x[0]) for x in one)}|{','.join(str(x[0]) for x in two)}")
            pairs += [(x[0], y[0]) for x in one for y in two if x[1] < y[2] and y[1] < x[2]]
        counts.update(pairs)
        links.append(pairs)
        rows.append([len(own_a), len(own_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*r[:3], len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), r[3]) for r, p in zip(rows, links, strict=True)]


HOSTILE = [None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b  ", "a\n b", "a \n", "x▁y", "▁", "<|endoftext|> a <s> </s><unk><0x41>",
           "日本語 のテキスト", "naïve ﬁ ½ ²  x", "　 \x1c \x85x", "\x00 b\x00", "😀😀 👩‍👩", "é ́", "  " * 40 + "x", "word" * 3_000, "don't we'll I'm",
           "tab\tand\r\nline", "a" * 70_000]


@pytest.fixture(scope="module")
def hostile_texts(spark):
    rng = random.Random(8)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "<|endoftext|>", "'s", "12", ".", "!?", "　", "😀", "Ünder", "ation", "▁"]
    own = ["".join(rng.choice(bits[:-1] if rng.random() < 0.9 else bits) for _ in range(rng.randint(0, 16))) for _ in range(400)]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    return HOSTILE + own + real + real[:5]


def alignment_rows(spark, texts, **options):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string, n_a string").repartition(3), **options).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(len(texts)))
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found]


def test_alignment_equals_all_overlaps(spark, hostile_texts):
    want = plain_alignment(hostile_texts)
    got = alignment_rows(spark, hostile_texts)
    for text, g, w in zip(hostile_texts, got, want, strict=True):
        assert g == w, repr(text)[:200]
    assert want[7][:3] != (0, 0, 0) and want[11][0] == 0


def test_alignment_in_many_shards_and_runs(spark, hostile_texts, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_RECORDS", 100)
    monkeypatch.setattr(alignment, "RUN_RECORDS", 500)
    monkeypatch.setattr(alignment, "KEPT_UNITS", 300)
    monkeypatch.setattr(alignment, "ROWS_A_CALL", 16)
    assert alignment_rows(spark, hostile_texts, shard_bytes=2_000) == plain_alignment(hostile_texts)


def test_records_with_many_times():
    layout = alignment.Layout(50_257, 32_000, 4)
    pairs = np.array([(31_999 << 32) | 50_256, 5, (16 << 32) | 7], np.uint64)
    records = layout.records(pairs, np.array([0, 1, 2]), np.array([200_000, 65_535, 1]))
    pair, doc, times = layout.parts(np.sort(records))
    assert Counter({d: times[doc == d].sum() for d in (0, 1, 2)}) == {0: 200_000, 1: 65_535, 2: 1} and len(records) == 6
    assert len(set(pair.tolist())) == 3 and (np.diff(layout.radix(np.sort(records))) >= 0).all()


def test_alignment_ids_and_empty_table(spark):
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, "")], "doc_id bigint, text string")
    found = alignment.align(odd).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in found) == [(0, 2, 4), (0, 2, 4), (7, 0, 0), (7, 0, 0)]
    assert alignment.align(odd.limit(0)).collect() == []


# --- language -------------------------------------------------------------------------------

def test_filters_hold_what_the_counts_say(spark, small):
    """Each language's filter has every sequence that passes the shares, and few others."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    filters = language.fit(docs)
    counts = defaultdict(Counter)
    for r in docs.select("lang", "text").collect():
        if r.lang is None or r.text is None:
            continue
        word = ""
        for c in r.text.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                padded = f" {word} "
                counts[r.lang].update(padded[i:i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1) if padded[i:i + n].strip())
                word = ""
    assert filters.languages == sorted(counts)
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {g: n / total[k] for g, n in c.items()} for k, c in counts.items()}
    best = Counter()
    for c in share.values():
        for g, s in c.items():
            best[g] = max(best[g], s)

    def held(i, gram):
        code = np.full(1, language.GOLDEN)
        for c in gram:
            code = language.mix(code * language.GOLDEN + np.uint64(ord(c)))
        return all(int(filters.planes[0][at[0]]) >> i & 1 for at in language.slots(code, len(filters.planes[0]), filters.hashes))

    wrong = others = 0
    for i, k in enumerate(filters.languages):
        for g in best:
            if share[k].get(g, 0) >= max(language.LEAST_SHARE, language.OF_BEST * best[g]):
                assert held(i, g), (k, g)
            else:
                others += 1
                wrong += held(i, g)
    assert wrong <= 0.002 * others


def test_counts_are_sums_over_sequences():
    plane = np.zeros(1 << 12, np.uint8)
    for word, bit in (("der", 1), ("die", 1), ("the", 2), ("de", 4)):
        for grams in [language.ngrams([word])[0]]:
            for at in language.slots(grams, len(plane), 4):
                np.bitwise_or.at(plane, at, np.uint8(bit))
    filters = language.LanguageFilters(["de", "en", "fr"], [plane], 4)
    counts = filters.counts(["der", "the", "zzz"])
    # 3 letters, 4 pairs with borders, 3 triples, 2 fours
    assert counts[:, -1].tolist() == [12, 12, 12] and counts[0, 0] == 12 and counts[1, 1] == 12 and counts[2].max() == 12
    names, scores = filters.decide(counts)
    assert names[:2] == ["de", "en"] and scores[:2] == [1.0, 1.0] and scores[2] < 0.1


def test_many_languages_fill_several_planes(spark):
    rng = random.Random(9)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(70)}
    rows = [(k, " ".join(w)) for k, w in words.items()]
    filters = language.fit(spark.createDataFrame(rows, "lang string, text string"), size=1 << 16, of_best=0.9)
    assert len(filters.planes) == 2 and filters.planes[0].dtype == np.uint64
    frame = spark.createDataFrame([(k, " ".join(w[:4])) for k, w in words.items()], "want string, text string")
    assert all(r.want == r.lang_pred for r in language.predict(frame, filters).collect())


def test_language_query(spark):
    folder = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op13_language"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang is not None]
    assert sum(held) / len(held) > 0.98


def test_language_of_odd_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    filters = language.fit(docs.filter(language.fold("doc_id") != language.HELD_OUT))
    texts = [None, "", " 12 ½ !?\n", "中文", "the " * 200_000, "ünd", "x" * 300_000]
    rows = [(t, "kept", "kept") for t in texts]
    found = language.predict(spark.createDataFrame(rows, "text string, lang_pred string, lang string"), filters)
    assert found.columns == ["text", "lang", "lang_pred", "score"]
    got = {r.text: (r.lang_pred, r.score) for r in found.collect()}
    assert [got[t] for t in texts[:3]] == [("und", 0.0)] * 3
    assert got["中文"] == (filters.languages[0], 0.0) and got[texts[4]][0] == "en" and got[texts[4]][1] > 0.9
    assert all(r.lang == "kept" for r in found.collect())
    assert language.predict(spark.createDataFrame([], "text string"), filters).collect() == []


def test_no_labelled_text(spark):
    frame = spark.createDataFrame([(None, "a text"), ("en", None)], "lang string, text string")
    filters = language.fit(frame)
    assert filters.languages == []
    assert [tuple(r)[2:] for r in language.predict(frame, filters).collect()] == [("und", 0.0)] * 2


def test_language_is_not_read_from_labels(spark, small):
    """The prediction of a text does not change with its label, source or id."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    filters = language.fit(docs)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", -F.col("doc_id"))
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, filters).collect()}
    two = {-r.doc_id: (r.lang_pred, r.score) for r in language.predict(changed, filters).collect()}
    assert one == two
