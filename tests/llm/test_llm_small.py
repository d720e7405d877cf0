"""Operators on small fixtures: brute force, round trips, and the defined results of odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from recfold.llm import chat, common, decontaminate, graph, html_extract, licenses, orc_output, packing, quality, queries, simhash, suffix_dedup, token_counts, tokens
from recfold.llm.common import fresh_path, is_scan, numbered, table
from recfold.llm.queries import tokenizer_path

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "\n", "a", "a b", "a  b", "x.\n\ny", " lead", "trail ", "é, ñ. ß!", "日本語。 テスト", "a<|endoftext|>b", "don't we'll", "1,234.5 99.", "▁x ▁", "a\tb\rc", "word " * 3000, "\x00 \x1c", "...", "A-B_c (d), \"e\"."]


def docs(spark, rows):
    """Rows of (doc_id, text) with further columns, some of whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, found double")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_token_ids_equal_the_library():
    enc = tokens.WordEncoder(tokenizer_path(BPE))
    ids, bounds = enc.encode(pa.array(ODD))
    want = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cé.,\n\t 1'<|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, bounds = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    found = token_counts.token_counts(docs(spark, [*enumerate(ODD), (None, "a")]), tokenizer_path(PIECES), limit=5)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 5) for i, t in [*enumerate(ODD), (None, "a")]]
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    proven = token_counts.whole_tokens(model)
    assert proven == token_counts.proven(tokenizer_path(PIECES)) and all(len(model.encode(w)) == 1 for w in proven)


def plain_best_fit(lengths, limit):
    """Piece by piece: the number of sequences."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            best = min(fits)
            room[room.index(best)] = best - n
        else:
            room.append(limit - n)
    return len(room), Counter(room)


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(30):
        limit = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(0, 300))]
        runs = packing.best_fit_decreasing(Counter(lengths), limit)
        used, taken = Counter(), set()
        for n, of in runs.items():
            ends = [r[0] for r in of[1:]] + [Counter(lengths)[n]]
            for (rank, first, each, at), end in zip(of, ends, strict=True):
                for k in range(end - rank):
                    sequence, offset = first + k // each, at + k % each * n
                    assert not taken & {(sequence, x) for x in range(offset, offset + n)}
                    taken |= {(sequence, x) for x in range(offset, offset + n)}
                    used[sequence] += n
        assert sum(used.values()) == sum(lengths) and all(x <= limit for x in used.values())
        assert (len(used), Counter(limit - x for x in used.values())) == plain_best_fit(lengths, limit)


def test_pack(spark):
    rows = [*enumerate(ODD), (5, "a b"), (None, "zz")]
    placed, cut = packing.pack(docs(spark, rows), tokenizer_path(BPE), max_len=64)
    enc = tokens.WordEncoder(tokenizer_path(BPE))
    ids = [x.tolist() + [2] for x in enc.whole([t or "" for _, t in rows])]
    found = placed.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == Counter(
        (d, s, e - s, zlib.crc32(np.array(x[s:e], "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True) for s, e in cuts(len(x), 64))
    room = defaultdict(list)
    for r in found:
        room[r.sequence_id].append((r.offset, r.length))
    for of in room.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(of), [*sorted(of)[1:], (sum(sorted(of)[-1]), 0)], strict=True)) and min(of)[0] == 0
    assert all(len(r["ids"]) <= 64 for r in packing.sequences(placed.filter("doc_id is not null and doc_id != 5"), cut).collect())


def cuts(n, most):
    first = n - (-(-n // most) - 1) * most
    return [(0, first), *((first + k, first + k + most) for k in range(0, n - first, most))]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert packing.pack(none, tokenizer_path(BPE))[0].count() == 0
    assert token_counts.token_counts(none, tokenizer_path(PIECES)).count() == 0
    assert quality.quality(none).count() == 0 and quality.quality_filter(none).columns == none.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert suffix_dedup.repeats(none).count() == 0 and suffix_dedup.remove_repeats(none).columns == none.columns
    benchmark = spark.createDataFrame([(1, "x " * 20)], "item_id long, text string")
    assert decontaminate.contaminations(none, benchmark).count() == 0
    assert decontaminate.contaminations(docs(spark, [(1, "x " * 20)]), benchmark.limit(0)).count() == 0
    assert licenses.scan(none).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    path = fresh_path(spark, "orc")
    orc_output.write_orc(none, path, tokenizer_path(BPE))
    assert orc_output.digests(orc_output.read_orc(spark, path)).count() == 0


def test_orc_round_trip_and_pruning(spark):
    rows = [(9, "b c"), (3, None), (7, "a"), (7, "a"), (None, "q"), (1, "word " * 500)]
    path = fresh_path(spark, "orc")
    orc_output.write_orc(docs(spark, rows), path, tokenizer_path(BPE))
    read = orc_output.read_orc(spark, path)
    enc = tokens.WordEncoder(tokenizer_path(BPE))
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = enc.whole([t or ""])[0].tolist() + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(orc_output.digests(read), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert "EqualTo(doc_id,7)" in read.filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert read.filter("doc_id = 7").count() == 2


def test_orc_files_have_stripes_indexes_and_bloom_filters(spark):
    path = fresh_path(spark, "orc")
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(4000)]
    orc_output.write_orc(docs(spark, rows).coalesce(1), path, tokenizer_path(BPE), stripe_bytes=1 << 16, index_rows=1000)
    orc = spark.sparkContext._jvm.org.apache.orc
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f for f in spark.read.orc(path).inputFiles()]
    stripes, kinds, upto = 0, set(), []
    for name in sorted(files):
        reader = orc.OrcFile.createReader(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), orc.OrcFile.readerOptions(conf))
        stripes += reader.getStripes().size()
        stats = reader.getStatistics()[2]  # of doc_id
        if stats.getNumberOfValues():
            upto.append((stats.getMinimum(), stats.getMaximum()))
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert footer.getColumns(5).getKind().toString() in ("DIRECT_V2", "DIRECT")  # of ids: run lengths
    assert stripes > len(files) and {(2, "ROW_INDEX"), (2, "BLOOM_FILTER_UTF8")} <= kinds
    assert all(a[1] < b[0] for a, b in zip(upto, upto[1:], strict=False))  # ascending in the order of names
    found = orc_output.digests(orc_output.read_orc(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(4000))


def plain_quality(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {i + k for i in range(len(words) - 4) if five[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), sum(a == b for a, b in zip(words, words[1:], strict=False))


def test_quality_counts():
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("a b c dd".split()) for _ in range(rng.randint(0, 30))) for _ in range(200)), "\n".join(rng.choice(["x y", "", " ", "z"]) for _ in range(50)), " ".join(map(str, [*range(7000), *range(100)]))]
    for t in texts:
        assert quality.text_counts(t) == plain_quality(t)


def plain_kept(rows):
    """Of (text, lang, source): whether each is kept, by sorted values rather than sketches."""
    floor = lambda v: v if v < 16 else v >> v.bit_length() - 5 << v.bit_length() - 5
    counts = [plain_quality(t) for t, _, _ in rows]
    failed = [n < 10 or 100 * twice > 20 * n for n, _, _, _, twice, _ in counts]
    ratios = [(s * 10**6 // max(c, 1), c * 1000 // max(n, 1), d * 10**6 // max(n, 1), e * 10**6 // max(n, 1)) for n, c, s, d, _, e in counts]
    kept = [not f for f in failed]

    def quartiles(inside, r):
        v = sorted(floor(ratios[i][r]) for i in inside if not failed[i])
        return [v[-(-len(v) * k // 4) - 1] if v else 0 for k in (1, 2, 3)], len(v)

    for r in range(4):
        every, _ = quartiles(range(len(rows)), r)
        levels = {}
        for lang in {x[1] for x in rows}:
            of, n = quartiles([i for i, x in enumerate(rows) if x[1] == lang], r)
            of = [(n * a + max(200 - n, 0) * b) // max(n, 200) for a, b in zip(of, every, strict=True)]
            for source in {x[2] for x, f in zip(rows, failed, strict=True) if x[1] == lang and not f}:
                own, n = quartiles([i for i, x in enumerate(rows) if x[1:] == (lang, source)], r)
                levels[lang, source] = [(n * a + max(200 - n, 0) * b) // max(n, 200) for a, b in zip(own, of, strict=True)]
        spreads = sorted(q3 - q2 for _, q2, q3 in levels.values())
        usual = spreads[(len(spreads) + 1) // 2 - 1]
        for i, x in enumerate(rows):
            if not failed[i]:
                q1, q2, q3 = levels[x[1:]]
                high = q2 + 8 * min(q3 - q2, max(q2 - q1, usual))
                n_words, chars, symbols, lines, _, echoes = counts[i]
                if r == 1:
                    kept[i] &= q2 - max(8 * (q2 - q1), q2 // 2) <= ratios[i][1] <= max(high, q2 + q2 // 2)
                else:
                    kept[i] &= max((symbols, 0, lines, echoes)[r] - 3, 0) * 10**6 <= high * max((chars, 0, n_words, n_words)[r], 1)
    return kept


def quality_rows():
    """Sources with other usual levels, one of which is junk to 40 %, and texts out of their source's range."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    prose = lambda marks, n=60: " ".join(word() + ("#" if rng.random() < marks else "") for _ in range(n))
    rows = [(prose(0), "en", "clean") for _ in range(300)] + [(prose(0.3), "en", "code") for _ in range(300)] + [(prose(0) if i % 5 < 3 else prose(0) + " $$$$$$" * 12, "en", "mixed") for i in range(500)]
    rows += [(prose(0.002), "de", "clean") for _ in range(250)] + [(prose(0), None, None) for _ in range(20)]
    rows += [(prose(0.3), "en", "clean"), (prose(0) + " ######" * 30, "en", "code"), (" ".join("a b c d e f g h i j k l".split() * 1), "en", "clean"), (" ".join(f"{word()} " * 2 for _ in range(40)), "de", "clean"), ("short", "en", None), (None, None, None), ("", "de", "clean")]
    rows.append(("\n".join([*(prose(0, 9) for _ in range(20)), *["one line"] * 30]), "de", "clean"))
    return rows


def test_quality_cutoffs_follow_their_source(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = [r.kept for r in quality.quality(df).orderBy("doc_id").collect()]
    assert kept == plain_kept(rows)
    assert all(kept[:300]) and all(kept[300:600]) and [kept[i] for i in range(600, 1100)] == [i % 5 < 3 for i in range(500)]
    assert not any(kept[1370:])  # what is usual in one source is not in another
    cuts = {(r.cut_lang, r.cut_source): r for r in quality.cutoffs(quality.sketches(quality.with_counts(df, "counts").select("lang", "source", "counts.*"))).collect()}
    assert cuts["en", "code"].most_symbols > 0 == cuts["en", "clean"].most_symbols and cuts["en", "mixed"].most_symbols < 150_000


def test_sketch_buckets_are_monotone_and_tight(spark):
    values = sorted({*range(200), *(random.Random(1).randint(0, 10**9) for _ in range(300))})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", quality.bucket(df.v).alias("b"), quality.bucket_floor(quality.bucket(df.v)).alias("f")).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(got, got[1:], strict=False))
    assert all(r.f <= r.v <= r.f * 17 / 16 + 1 for r in got)


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(300, 300 + i) for i in range(1, 50)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert found == {n: r for n, r in plain_components([p for p in pairs if p[0] != p[1]], nodes).items()}


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(60)] for _ in range(12)]
    texts = [*ODD]
    for words in base:
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    fps = {i: plain_fingerprint(t, 4) for i, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    root = plain_components(pairs, list(fps))
    got = rows_of(simhash.near_duplicates(docs(spark, [*rows, (None, "a b c")])).filter("doc_id is not null"), "doc_id", "fp", "component_id")
    assert got == sorted(((i, np.uint64(fps[i]).astype(np.int64).item(), root[i]) for i in fps), key=repr)


def test_links_keep_components_in_dense_and_split_buckets(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components([(a, b) for a, x in zip(signed, fps, strict=True) for b, y in zip(signed, fps, strict=True) if a < b and (x ^ y).bit_count() <= 4], signed)
    for block in (4096, 16):
        found = [(r.u, r.v) for r in simhash.links(df, shared=1, block=block).collect()]
        assert plain_components(found, signed) == want


def test_drop_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    near = list(words)
    near[150] = "other"
    half = words[:150] + [f"q{rng.random()}" for _ in range(150)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (7, " ".join(half)), (1, "alone here"), (None, " ".join(words)), (8, None), (6, "")]
    kept = simhash.drop_near_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7] and kept.columns[-2:] == ["row", "found"]


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if covered[i] and (not i or not covered[i - 1]))
        out.append((len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_by_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    shared = [make(rng.randint(15, 120)) for _ in range(6)]
    texts = [*ODD, "ab" * 200, "ab" * 150 + "x", "a" * 77, shared[0], shared[0]]
    for _ in range(40):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [s[a:b], make(rng.randint(0, 40))]
        texts.append("".join(parts))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    found = suffix_dedup.digests(suffix_dedup.repeats(docs(spark, enumerate(texts)), length=20))
    want = [(i, *x) for i, x in enumerate(plain_repeats(texts, 20))]
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


# Two different texts whose rolling hashes modulo 2 ** 64 are equal under any odd multiplier.
ALIKE = [
    "hydditovhostcknlkavhhmknfbixoxeroaeftmgg=..=.==..==.=..=.==.=..==..=.==.6VV6V66VV66V6VV6V66V6VV66VV6V66VNUUNUNNUUNNUNUUNUNNUNUUNNUUNUNNUImmImIImmIImImmImIImImmIImmImIIm+((+(++((++(+((+(++(+((++((+(++(",
    "hydditovhostcknlkavhhmknfbixoxeroaeftmgg.==.=..==..=.==.=..=.==..==.=..=V66V6VV66VV6V66V6VV6V66VV66V6VV6UNNUNUUNNUUNUNNUNUUNUNNUUNNUNUUNmIImImmIImmImIImImmImIImmIImImmI(++(+((++((+(++(+((+(++((++(+((+",
]


def test_strings_that_weak_identifiers_confuse_stay(spark):
    found = suffix_dedup.digests(suffix_dedup.repeats(docs(spark, enumerate([*ALIKE, ALIKE[0] + "x"]))))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {0: 200, 1: 0, 2: 200}


def test_identifiers_that_clash_are_made_anew(spark):
    bits, rng = 6, random.Random(6)
    shared = ["".join(rng.choice("abcdef") for _ in range(90)) for _ in range(4)]
    texts = ["".join("".join(rng.choice("ghij") for _ in range(rng.randint(5, 60))) + rng.choice(shared)[rng.randint(0, 40) :] for _ in range(3)) for _ in range(30)]
    rows = docs(spark, enumerate(texts))
    found = suffix_dedup.digests(suffix_dedup.repeats(rows, length=20, first_bits=bits))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *x) for i, x in enumerate(plain_repeats(texts, 20))), key=repr)
    first = suffix_dedup.claimed_intervals(numbered(rows.select("doc_id", "text"), "row"), 20, 0, bits)
    assert suffix_dedup.differ(numbered(rows.select("doc_id", "text"), "row"), first, 20)  # or this test says nothing


def test_large_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPANS_PER_SHARE", 4)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("ijklmn") for _ in range(30)) + passage + "".join(rng.choice("opqrst") for _ in range(30)) for _ in range(40)]
    found = suffix_dedup.digests(suffix_dedup.repeats(docs(spark, enumerate(texts)), length=20))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *x) for i, x in enumerate(plain_repeats(texts, 20))), key=repr)


def test_remove_repeats_keeps_the_other_columns(spark):
    passage = "".join(random.Random(1).choice("abcdé ") for _ in range(150))
    rows = [(1, "one " + passage), (2, passage + " two"), (3, passage), (4, None), (5, "plain"), (6, "")]
    out = suffix_dedup.remove_repeats(docs(spark, rows), length=100)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one ", 2: " two", 4: None, 5: "plain", 6: ""}
    assert out.columns == docs(spark, []).columns and out.first()["row"] == "x"


def test_decontamination(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 60, 9, 20, 4])] + [(5, None), (6, ""), (None, " ".join(word() for _ in range(7)))]
    filler = lambda n: " ".join(word() for _ in range(n))
    swap = lambda text, at: " ".join("zzzz" if i in at else w for i, w in enumerate(text.split()))
    rows = [
        (1, filler(20) + " " + items[0][1].upper().replace(" ", ", ") + " " + filler(5)), (2, swap(items[1][1], {7, 25, 41})), (3, filler(3) + " " + items[2][1] + " " + filler(3)), (4, filler(200)), (5, None), (6, ""),
        (7, " ".join(items[3][1].split()[:6]) + " " + filler(30)), (8, items[4][1]), (9, "the " * 50), (None, items[0][1]),
        (10, filler(4) + " " + items[7][1]), (11, "more " + items[4][1]),  # an item without id; more than an item of four words
    ]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    for seeds in (100_000, 40):  # a benchmark that is broadcast, and one that is not
        found = decontaminate.contaminations(docs(spark, rows), benchmark, broadcast_seeds=seeds, broadcast_words=seeds)
        assert rows_of(found, "doc_id", "item_id") == sorted([(1, 0), (2, 1), (3, 2), (8, 4), (10, None), (None, 0)], key=repr)
    kept = decontaminate.decontaminate(docs(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9, 11]


def plain_best(ours, theirs, share, gap):
    """(most, of): the best stretch over agreeing places, by trying all of them."""
    same = [a == b for a, b in zip(ours, theirs, strict=True)]
    best = (0, 0)
    for i, x in enumerate(same):
        if x and (not i or not same[i - 1]):
            agree = gone = 0
            for j in range(i, len(same)):
                agree, gone = (agree + 1, 0) if same[j] else (agree, gone + 1)
                if gone > gap:
                    break
                if same[j] and agree >= share * (j - i + 1):
                    best = max(best, (agree, j - i + 1))
    return best


def test_contaminations_by_brute_force(spark):
    rng = random.Random(23)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [[word() for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 9, 11, 13, 16, 18, 20, 25, 40]))] for _ in range(50)]
    texts = [items[1], items[1][:2]]
    for _ in range(250):
        item = rng.choice(items)
        a = rng.randint(0, len(item) // 3)
        part = [word() if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else w for w in item[a : a + rng.randint(3, 40)]]
        texts.append([word() for _ in range(rng.randint(0, 30))] + part + [word() for _ in range(rng.randint(0, 30))])
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            n = len(item)
            if n < 5:
                if text == item:
                    want[d, i] = n
                continue
            best = max(plain_best([text[k] if 0 <= k < len(text) else None for k in range(at, at + n)], item, 0.7, 3)[0] for at in range(1 - n, len(text)))
            if best >= (n if n < 8 else min(13, -(-7 * n // 10))):
                want[d, i] = best
    rows = docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)])
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for seeds in (100_000, 10):
        found = {(r.doc_id, r.item_id): r.n_words for r in decontaminate.contaminations(rows, benchmark, broadcast_seeds=seeds, broadcast_words=seeds).collect()}
        assert set(found) == set(want) and len(want) > 80
        assert all(0.7 * want[k] <= found[k] <= want[k] for k in want)


def test_licenses(spark):
    three = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    warranty = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, f"{three}\n{notice}\n\nwords between\n{warranty}"), (2, f"{warranty}\n{notice}\n{three}"), (3, "Text.\nLicensed under the Apache License, Version 2.0.\nMore"), (4, None), (5, ""), (None, "Released under the MIT License."), (6, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    found = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(docs(spark, rows)).collect()}
    assert found[1] == (["mit-grant", "mit-notice", "mit-warranty"], ["MIT"]) and found[2][1] == []
    assert found[3] == (["apache-2.0"], ["Apache-2.0"]) and found[4] == ([], []) and found[5] == ([], [])
    assert found[None] == (["mit-released"], ["MIT"]) and found[6][1] == ["MIT", "CC-BY-NC-4.0"]


# Texts of public licences, as they are published.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."


def test_licence_texts_in_every_layout(spark, tmp_path):
    import textwrap

    wrapped = lambda text, width, leader="": "\n".join("\n".join(leader + x for x in textwrap.wrap(p, width) or [""]) for p in text.split("\n"))
    texts, rows, want = {"MIT": MIT_TEXT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL_3, "ISC": ISC, "Unlicense": UNLICENSE}, [], []
    for name, text in texts.items():
        for shown in (text, wrapped(text, 72), wrapped(text, 40), wrapped(text, 76, "# "), wrapped(text, 70, " * "), wrapped(text, 60, "// ").replace("\n", "\r\n"), "Some words before.\n\n" + wrapped(text, 65) + "\n\nand after"):
            rows.append(shown), want.append([name])
    lines = {
        "SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;": ["Apache-2.0", "MIT"], "This project is licensed under the MIT License.": ["MIT"], "Released under the GNU GPL v3 or later.": ["GPL-3.0-or-later"],
        'Licensed under the Apache License, Version 2.0 (the "License");': ["Apache-2.0"], "Available under the Mozilla Public License, version 2.0": ["MPL-2.0"], "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "The code is distributed under the terms of the BSD 3-Clause License.": ["BSD-3-Clause"], "No licence here, but copyright and permission.": [], BSD_2 + "\n" + BSD_3: ["BSD-2-Clause", "BSD-3-Clause"], BSD_3 + "\n\n" + BSD_2: ["BSD-2-Clause", "BSD-3-Clause"],
        "first line\nReleased under the MIT License.\nanother line": ["MIT"],
    }
    rows, want = rows + list(lines), want + list(lines.values())
    found = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, enumerate(rows))).collect()}
    docs(spark, enumerate(rows)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = sorted(duck.sql(queries.SQL["op6_license_scan"]).fetchall())
    assert sql == sorted(map(tuple, queries.op6_license_scan(spark, str(tmp_path)).collect()))
    assert [(rows[i], found[i], sorted(w)) for i, w in enumerate(want) if sorted(found[i]) != sorted(w)] == []


HARD = ["<|end|>", "<|turn|>user<|says|>", "\\s\\l<\\|", "\\### Assistant: </turn> ok", "<", "|end|>", "", None, "a\nb"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant", None, "<|says|>"] * 3, HARD, strict=False))] + [(3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(df.text).alias("parts")))
    read = {r.conv_id: r for r in chats.withColumn("turns", chat.read_turns(chats.formatted)).withColumn("loss", chat.read_loss(chats.formatted, chats.loss_spans)).collect()}
    for c in (1, 2):
        assert [(t.role, t.text) for t in read[c].turns] == [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert read[c].loss == "".join(t or "" for i, _, r, t in rows if i == c and r == "assistant")
        assert all(read[c].formatted[s.start - s.offset :].startswith(chat.TURN + "assistant" + chat.SAYS) for s in read[c].loss_spans)
    assert read[3].n_turns == 2 and read[3].loss == "xx" and read[None].loss == "n"


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("text", "|end|>", None, None), ("image", None, "img://1", 4), ("audio", None, "a", None), ("document", None, "d", 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.format_chat(df).first()
    assert out.formatted == "<|turn|>user<|says|>see \\l|end|><|image|><|audio|><|document|><|end|><|turn|>assistant<|says|><|end|>"
    assert [tuple(a) for a in out.attachments] == [("image", "img://1", 1024), ("audio", "a", 25), ("document", "d", 1024)]
    assert out.formatted[out.loss_spans[0].start :][: out.loss_spans[0].length] == "" and out.loss_spans[0].turn == 1
    tied = spark.createDataFrame([(1, 0, "user", [("image", None, r, 1)]) for r in ("b", "a", "c")], df.schema)
    for rows in (tied, tied.orderBy(chat.F.monotonically_increasing_id().desc())):
        assert [a.ref for a in chat.format_chat(rows).first().attachments] == ["a", "b", "c"]
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="unknown part kind"):
        chat.format_chat(spark.createDataFrame([(1, 0, "u", [("video", None, None, None)])], df.schema)).collect()


PAGE = """<!doctype html><html><head><title>t</title><style>x</style></head><body><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav></header><div class="cookie-banner"><p>We use cookies here.</p></div>
<div id="main"><aside class="sidebar"><h3>More</h3><p>Something on the side.</p></aside><article><h1>The real title</h1><p>First &amp; more<br>text   here.</p><div class="ad">Buy now</div><p>Second <a href=x>one</a>.<p>Third<ul><li>one<li>two</ul><form><p>Sign up</p><button>Go</button></form></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Reader says quite a long thing here which is no main text at all, really.</p></div></section></div><footer>&copy; 2020</footer><script>var a="</p>";</script>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", "<nav>menu</nav>", 0), (4, "u", "<p>a<b", 0), (5, "u", "plain &lt;text", 0)], "page_id long, url string, html string, text int")
    found = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert found[1][0] == "The real title\nFirst & more text here.\nSecond one.\nThird\none\ntwo"
    assert found[1][1] == len(found[1][0]) and found[2] == ("", 0) and found[None] == ("", 0) and found[3] == ("", 0) and found[5][0] == "plain <text"


BODY = "<article><p>Hello there my friends, this is text.</p><p>And here is more of it.</p></article>"
SAID = "Hello there my friends, this is text.\nAnd here is more of it."


def test_html_that_leaves_elements_open():
    text = html_extract.default_model().extract
    for before in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title><style>a{}</style>", "<title>T</title>", "<head><script>x</script></head><body>", "<body><svg viewBox='0'/>", "<body><iframe src=x>", "<body><select>", "<body><object data=x>", "<body><button>", "<body><video src=x>"):
        assert text(before + BODY) == SAID, before
    assert text("<body>" + BODY + "<script>var a = 1; <p>never</p>") == SAID and text("<body>" + BODY + "<!-- <p>never</p>") == SAID
    assert text("<body><svg><title>no</title></svg><iframe>no</iframe><noscript>no</noscript>" + BODY) == SAID
    assert text(BODY.replace("<article>", '<article class="post sidebar-layout has-comments">')) == SAID
    assert text(BODY.replace("text.", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>.")) == SAID.replace("text.", "x=1.")
    assert text("<select>" * 3000 + BODY) == SAID  # in one pass


def test_html_held_out_pages_are_whole():
    """Whole pages of the held-out generator against the text of their labelled blocks."""
    model, right, pages = html_extract.default_model(), 0, html_extract.labelled_pages(100, seed=99)
    for page in pages:
        nodes, blocks = html_extract.parse(page)
        right += model.extract(page) == "\n".join(t for i, t in blocks if nodes[i].label == "C")
    assert right / len(pages) > 0.8


def test_html_held_out_accuracy():
    model, right, n = html_extract.default_model(), 0, 0
    for page in html_extract.labelled_pages(80, seed=1234):
        nodes, blocks = html_extract.parse(page)
        belief = model.marginals(nodes)
        for i, _ in blocks:
            right += (belief[i][1] == max(belief[i])) == (nodes[i].label == "C")
            n += 1
    assert right / n > 0.93


def test_html_marginals_equal_enumeration():
    import itertools

    model = html_extract.Model.fit(html_extract.labelled_pages(60))
    nodes, _ = html_extract.parse("<div><p>some text here<ul><li>a</ul></div>")
    belief, y = np.array(model.marginals(nodes)), range(3)
    found, total = html_extract.features(nodes), np.zeros((len(nodes), 3))
    for labels in itertools.product(y, repeat=len(nodes)):
        if labels[0] != 0:
            continue
        p = 1.0
        for i in range(1, len(nodes)):
            pair = model.pairs.get(nodes[i].tag) or model.pairs[html_extract.ANY]
            p *= pair[labels[nodes[i].parent]][labels[i]] * np.exp(sum(model.unary.get(f, html_extract.UNSEEN)[labels[i]] for f in found[i]))
        for i, label in enumerate(labels):
            total[i, label] += p
    assert np.allclose(belief, total / total.sum(axis=1, keepdims=True))


#: Names that operators use for columns of their own.
CLASHES = "row found kept base_failed cut_lang cut_source most_symbols least_length all of_lang file_number numbered_file numbered_nth numbered_place quality_counts hit_doc words seed at key n id root rank counts n_words row_ found_".split()


@pytest.mark.parametrize("stored", [True])
def test_columns_with_clashing_names_are_kept(spark, tmp_path, stored):
    rng = random.Random(12)
    words = [f"word{rng.randint(0, 900)}" for _ in range(60)]
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "other " * 3 + passage + " ".join(words[::-1])), (4, passage + " ".join(reversed(words[:50]))), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "s", *(f"{c}{i}" for c in CLASHES)) for i, t in rows], ", ".join(["doc_id long, text string, lang string, source string", *(f"`{c}` string" for c in CLASHES)]))
    if stored:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    benchmark = spark.createDataFrame([(1, " ".join(words[:20]), "x")], "item_id long, text string, words string")
    for stage, left in ((quality.quality_filter, {1, 2, 3, 4}), (simhash.drop_near_copies, {1, 3, 4, 5}), (suffix_dedup.remove_repeats, {3, 5}), (lambda d: decontaminate.decontaminate(d, benchmark), {3, 4, 5})):
        out = stage(df)
        got = out.collect()
        assert out.columns == df.columns and {r.doc_id for r in got} == left
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES)
    for thin in (quality.quality, suffix_dedup.repeats, simhash.near_duplicates, licenses.scan, lambda d: packing.pack(d, tokenizer_path(BPE))[0], lambda d: token_counts.token_counts(d, tokenizer_path(PIECES))):
        assert thin(df).count() >= 5


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_scans_are_told_apart(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    assert is_scan(df) and is_scan(df.select("doc_id", "text"))
    both = [{(r.doc_id, r.row) for r in numbered(df, "row").repartition(k).collect()} for k in (1, 3)]
    assert both[0] == both[1] and len({r for _, r in both[0]}) == df.count()
    assert not is_scan(df.repartition(2)) and not is_scan(docs(spark, [(1, "a")]))
