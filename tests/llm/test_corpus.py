"""Corpus operators against brute force, and on nulls, empties, repeats, clashing columns and empty tables."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gneiss.llm import ann, bpe, common, license, linededup, packing, pii, quality, queries, setsketch, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, row string, members string"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def some_texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 90))) for _ in range(25)]
    out = []
    for b in base:
        out += [b, b]
        w = b.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    common_line = "  The SAME line\t"
    out = [t + "\n" + common_line if k % 4 == 0 else t for k, t in enumerate(out)]
    out += [None, "", " ", "\n\n", "one", "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, tel +49 (30) 123456", "x" * 50_000, "<|endoftext|> İ é́ \x1c \x85 a  b", "ab " * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None if t is None else len(t), "k", 7, "r", "m") for k, t in enumerate(some_texts())]
    rows.append((None, "no id here", "de", "s1", 10, None, None, None, None))
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_lines(docs, texts, empty):
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, t in texts for k in {strip(x) for x in (t or "").split("\n")})
    want = []
    for d, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not strip(x) or found[strip(x)] < 10]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    for batches, fanout in ((5, 4), (1, 4), (7, 2)):
        got = [tuple(r) for r in linededup.dedup_lines(docs, batches=batches, fanout=fanout).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 10
    kept = linededup.drop_lines(docs)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted(w[3] for w in want)
    assert linededup.dedup_lines(empty).count() == 0 and linededup.drop_lines(empty).count() == 0


def test_bpe(docs, texts, empty):
    t = Tokenizer.from_file(BYTE)
    want = []
    for d, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.bpe_round_trip(docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [tuple(r) for r in bpe.bpe_digests(docs, BYTE).collect()]
    assert sorted(digests, key=str) == sorted(((d, len(i), sha(",".join(map(str, i))), sha(x)) for d, i, x in want), key=str)
    assert bpe.bpe_digests(empty, BYTE).count() == 0
    own, rnd = bpe.loaded(BYTE), random.Random(2)
    for _ in range(2000):
        s = "".join(rnd.choice("ab'stred \n\t\x85\xa01é。<|>\x1f ingth") for _ in range(60))
        assert own.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_packing(docs, texts, empty):
    t = Tokenizer.from_file(WORD)
    rows = packing.pack(docs.repartition(5), WORD, size=256, open_windows=3, merge_fan=2).collect()
    whole = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for d, x in texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for (d, ids), n in whole.items():
        want = Counter()
        got = Counter((r.start, r.length, r.ids_crc32) for r in pieces[d])
        for (start, length, crc), k in got.items():
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
            want[start] += k * length
        assert sum(want.values()) == n * len(ids) and {r.doc_tokens for r in pieces[d]} == {len(ids)}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in rows) > 0.8 * 256 * len(sequences)
    assert packing.pack(empty, WORD).count() == 0
    words, rnd = packing.loaded(WORD), random.Random(3)
    odd = ["".join(rnd.choice("aAb'steD.,! \n\t\x85\xa01é́Σς。<|>\x1f ingthİ̸") for _ in range(60)) for _ in range(2000)]
    for s, ids in zip(odd, words.encode_batch(odd), strict=True):
        assert ids.tolist() == t.encode(s, add_special_tokens=False).ids + [2], s


def sets_of(texts, k):
    out = []
    for d, t in texts:
        w = [lower(x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates(docs, texts, empty, k, small):
    known = [(d, s) for d, s in sets_of(texts, k) if d is not None]
    up = {d: d for d, _ in known}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    links = 0
    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links += 1
                p, q = sorted((top(a), top(b)))
                up[q] = p
    assert links > 30
    got = setsketch.near_duplicates(docs, k, small_bucket=small, block=4, out_block=2).collect()
    assert len(got) == len(texts)
    sizes = dict(sets_of(texts, k))
    for r in got:
        assert r.n_shingles == len(sizes[r.doc_id])
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert setsketch.near_duplicates(empty, k).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    a, b = words(59), words(59)
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join(a + ["x"])), (9, " ".join(b + ["x"]))]
    for _ in range(60):  # ids that repeat over mixed texts, null ids, identical rows
        base = words(40)
        for _ in range(rnd.randint(1, 4)):
            own = list(base)
            if rnd.random() < 0.6:
                own[rnd.randrange(40)] = "changed"
            rows.append((rnd.choice([None, *range(20, 90)]), " ".join(own)))
    rows += [rows[5], rows[5], (30, ""), (30, ""), (31, None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row_id string, text_key int")
    sets = sets_of(rows, 2)

    def groups(by_id):
        up = list(range(len(rows)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, (d, x) in enumerate(sets):
            for j in range(i):
                e, y = sets[j]
                if (x and y and 100 * len(x & y) >= 80 * len(x | y)) or (by_id and x and y and d is not None and d == e):
                    up[top(i)] = top(j)
        out = defaultdict(list)
        for i in range(len(rows)):
            out[top(i)].append(i)
        return out.values()

    want = []
    for g in groups(True):
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        want += [(rows[i][0], len(sets[i][1]), least if sets[i][1] else rows[i][0], (rows[i][0] == least or least is None) if sets[i][1] else True) for i in g]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs, 2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = setsketch.one_of_each_group(docs, 2)
    assert left.columns == docs.columns
    best = lambda g: min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5(rows[i][1].encode()).digest()))
    stay = [rows[best(g)] for g in groups(False) if sets[g[0]][1]] + [r for r, (_, x) in zip(rows, sets, strict=True) if not x]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(stay, key=str)
    none = docs.where("false")
    assert setsketch.one_of_each_group(none).count() == 0


def test_estimate_is_close():
    rnd, sketch = np.random.default_rng(1), setsketch.SetSketch(1024)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        x = setsketch.mix(rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = x[:n], np.concatenate((x[:both], x[n : 2 * n - both]))
        ra, rb = sketch.registers(a), sketch.registers(b)
        got = setsketch.estimated(ra[None], rb[None], np.array([n]), np.array([n]))[0]
        assert abs(got - both / (2 * n - both)) < 0.06
        assert (np.maximum(ra, rb) == sketch.registers(np.union1d(a, b))).all()  # mergeable


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 150: 100, 200: 100} | {500 + k: 500 for k in range(60)}


def test_quality(docs, texts, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(texts)
    want = []
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, mark = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [0] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(mark), len(w) < 20 or 100 * sum(mark) > 30 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in got)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_verdicts_follow_exact_quantiles(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(1500):
        words = [f"{'w' * rnd.randint(1, 9)}{rnd.randrange(400)}" + ("#" if rnd.random() < 0.05 * (k % 5) else "") for _ in range(rnd.randint(20, 80))]
        lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
        lines += rnd.choices(lines, k=rnd.choice([0, 0, 0, 1, 5]))
        rows.append((k, "\n".join(lines), f"l{k % 2}", f"s{k % 3}" if k % 7 else "rare"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    values = {}
    for d, text, lang, source in rows:
        n, chars, symbols, dup, repeat, n_lines = quality.measure(text)
        if not got[d].base_failed:
            values[d] = ((lang, source), {"symbol_share": symbols / n, "dup_line_share": dup / n_lines, "repeat_share": repeat / n, "word_length": chars / n})
    members = defaultdict(list)
    for g, v in values.values():
        members[g].append(v)
    assert min(map(len, members.values())) >= quality.LEAST_ROWS
    sure = 0
    for d, (g, own) in values.items():
        loose, strict = [], []
        for m, least in quality.MEASURES.items():
            all_ = np.array([v[m] for v in members[g]])
            for shift, out in ((0.04, loose), (-0.04, strict)):  # the sketch's rank error, well above its 1.7 percent
                low, mid_low, mid_high, top = (np.quantile(all_, q) for q in (0.25 - shift, 0.5 - shift, 0.5 + shift, 0.75 + shift))
                out.append(own[m] > mid_high + 3 * max(top - mid_high, least) + 3 * abs(shift) * (all_.max() - all_.min()) * np.sign(shift))
                if m in quality.BELOW:
                    out.append(own[m] < mid_low - 3 * max(mid_low - low, quality.BELOW[m]) - 3 * abs(shift) * (all_.max() - all_.min()) * np.sign(shift))
        if any(loose):
            assert not got[d].kept
        if not any(strict):
            assert got[d].kept
        sure += any(loose) or not any(strict)
    assert sure > 0.7 * len(values) and 20 < sum(not got[d].kept for d in values)


def test_fences(spark):
    clean = [(k, " ".join(f"word{(k * 7 + j) % 900}" for j in range(60)), "en", "a") for k in range(200)]
    dirty = [(1000, " ".join(f"#{j}%|" for j in range(60)), "en", "a")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(clean + dirty, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k].kept for k in range(200)) and got[1000].reason == "symbol_share"


def test_fences_hold_where_junk_is_many(spark):
    clean = [(k, " ".join(f"word{(k * 7 + j) % 900}" for j in range(60)), "en", "a") for k in range(200)]
    junk = [(1000 + k, " ".join(f"to%%%{k}x{j}" for j in range(60)), "en", "a") for k in range(20)]
    lines = [(2000, "\n".join(["again"] * 5 + [f"w{j}a w{j}b w{j}c w{j}d w{j}e w{j}f w{j}g" for j in range(6)]), "en", "a")]
    short = [(3000, " ".join("abcdefghijklmnopqrstuvwxyz"[j % 26] + "y" for j in range(26)), "en", "a")]
    long = [(4000, " ".join(f"longword{j:02d}" for j in range(26)), "en", "a")]
    rows = spark.createDataFrame(clean + junk + lines + short + long, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(rows).collect()}
    assert all(got[k].kept for k in range(200)) and all("symbol_share" in got[1000 + k].reason for k in range(20))
    assert "dup_line_share" in got[2000].reason and got[3000].reason == got[4000].reason == "word_length"


def test_small_groups_take_the_fences_of_a_wider_level(spark):
    text = lambda k: " ".join(f"word{(k * 7 + j) % 900}" for j in range(60))
    bad = " ".join(f"#{j}%|" for j in range(60))
    rows = [(k, text(k), "en" if k < 150 else None, f"s{k % 2}") for k in range(300)]
    rows += [(1000, bad, "en", "lone"), (1001, text(5), "en", "lone"), (1002, bad, "fr", "lone"), (1003, bad, None, None), (1004, text(6), "fr", "other")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k in sorted(got) if not got[k]] == [1000, 1002, 1003]


def test_pii(spark, docs, texts, empty):
    rows = pii.find_spans(docs).collect()
    assert len(rows) == len(texts)
    found = [r for r in rows if r.base]
    assert [[tuple(s) for s in r.base] for r in found] == [[("email", 5, 13), ("ip", 17, 25), ("card", 32, 51), ("phone", 57, 72)]]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[found[0].doc_id] == "mail [EMAIL] or [IP], card [CARD], tel [PHONE]" and clean[len(some_texts()) - 9] is None
    assert pii.find_spans(empty).count() == 0 and pii.sanitise(empty).columns == empty.columns
    told = [(k, f"The Zanzibar{'é' if k == 3 else ''} office writes to jo@x.org about plan {k}", "en") for k in range(6)]
    told += [(100 + k, f"The office is about nothing {k} and about plans", "en") for k in range(40)]
    out = pii.find_spans(spark.createDataFrame(told, "doc_id long, text string, lang string")).collect()
    terms = {r.doc_id: {dict(told_texts(told))[r.doc_id][t.start : t.end].lower() for t in r.terms} for r in out}
    assert terms[0] == {"zanzibar", "writes", "to", "plan"} and not any(terms[100 + k] for k in range(40))
    assert "Zanzibar" not in pii.sanitise(spark.createDataFrame(told, "doc_id long, text string, lang string")).where("doc_id = 0").first().text


def test_pii_terms_of_whole_documents(spark):
    filler = " ".join(f"plain{j}" for j in range(30))
    rows = [(k, f"plans {filler} and more") for k in range(400)]
    rows += [(1000, f"Zanzibar report\n{filler}\nwrite to jo@x.org soon\n{filler} Zanzibar"), (1001, "Contact\u00a0: mo@x.org " + filler)]
    rows += [(2000 + k, f"Quagga {filler} call me at kim@y.org {filler} quagga {k}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: [(dict(rows)[r.doc_id][t.start : t.end].lower(), t.start) for t in r.terms] for r in pii.find_spans(docs).collect()}
    assert [w for w, _ in out[1000]].count("zanzibar") == 2 and [w for w, _ in out[2003]].count("quagga") == 2
    assert any(w == "contact\u00a0" for w, _ in out[1001])
    assert not any(w.startswith("plain") for x in out.values() for w, _ in x) and not any(out[k] for k in range(400))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zanzibar" not in clean[1000] and "uagga" not in clean[2000] and filler in clean[1000] and clean[7] == dict(rows)[7]


def test_pii_terms_against_brute_force(spark):
    import math

    rnd = random.Random(21)
    common, rare = [f"w{k}" for k in range(60)], [f"Rare{k}" for k in range(80)]
    people = [f"p{k}@x.org" for k in range(8)] + ["10.0.0.1", "+49 30 1234567"]
    rows = []
    for k in range(700):
        words = [rnd.choice(common) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.15:
            own = rnd.sample(people, rnd.randint(1, 3))
            words += own + [f"Rare{people.index(e)}," for e in own if rnd.random() < 0.8] + [rnd.choice(rare)]
        elif rnd.random() < 0.05:
            words.append(rnd.choice(rare))
        rnd.shuffle(words)
        rows.append((k if rnd.random() < 0.97 else None, " ".join(words)))
    rows += [rows[5], rows[5], rows[40], (9999, None), (9999, "")]
    held, holds_term, holds_entity = [], Counter(), Counter()
    for _, text in rows:
        text = text or ""
        spans = pii.base_spans(text)
        entities = {pii.entity(kind, text[a:b]) for kind, a, b in spans}
        beside = {}
        for w, a, b in pii.words_of(text):
            if not any(a < y and x < b for _, x, y in spans):
                beside.setdefault(w, []).append((a, b))
        held.append((entities, beside))
        holds_term.update({w for w, _, _ in pii.words_of(text)})
        holds_entity.update(entities)
    both = Counter((e, w) for entities, beside in held for e in entities for w in beside)
    n = len(rows)

    def share(e, w):
        there = math.log(n / holds_entity[e])
        return math.log(both[e, w] * n / (holds_entity[e] * (max(holds_term[w], both[e, w]) + pii.UNSEEN))) / there if there > 0 else 0.0

    want = []
    for (d, text), (entities, beside) in zip(rows, held, strict=True):
        found = []
        for w, at in beside.items():
            best = max((share(e, w) for e in entities), default=0.0)
            found += [(a, b, round(best, 9)) for a, b in at if best >= 0.8]
        want.append((d, text or "", sorted(found)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = {(r.doc_id, r.k): r.text or "" for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    got = [(r.doc_id, keyed[r.doc_id, r.text_key], [(t.start, t.end, round(t.share, 9)) for t in r.terms]) for r in pii.find_spans(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(len(x) for _, _, x in want) > 100


def told_texts(rows):
    return [(r[0], r[1]) for r in rows]


def test_base_spans_match_the_patterns():
    rnd = random.Random(3)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    seen = Counter()
    for n in range(20_000):
        x = "".join(rnd.choice("a1.@-+ 4(2" if n % 2 else "0123456789 -") for _ in range(40))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, x):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind != "ip" or all(int(v) <= 255 for v in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
                if good:
                    want.append((kind, m.start(), m.end()))
                    seen[kind] += 1
        assert pii.base_spans(x) == want, x
    assert len(seen) == 4 and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_warc(spark, empty):
    pages = [(5, "https://www.Example.com:8080/b?z=1&a=2#f", "same"), (2, "http://example.com/a", "same"), (9, "http://example.com/a", "other\r\n\r\nWARC/1.1\r\n"), (3, None, None), (4, "x\r\nevil: 1", ""), (7, "http://a.org", "é€")]
    pages.append(pages[0])
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    got = warc.capture_histories(df).collect()
    assert len(got) == len(pages)
    keys = [warc.order((r.url_key, r.timestamp, r.page_id)) for r in got]
    assert keys == sorted(keys)
    for r in got:
        html = (next(h for k, _, h in pages if k == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {5: ("revisit", 2), 2: ("response", None), 9: ("response", None), 3: ("response", None), 4: ("revisit", 3), 7: ("response", None)}
    assert warc.capture_histories(spark.createDataFrame([], df.schema)).count() == 0
    assert warc.url_key("https://www.Example.com:8080/b?z=1&a=2#f") == "com,example)/b?a=2&z=1"
    nameless = spark.createDataFrame([(None, "http://a.org/1", "p"), (3, None, "p"), (None, "u", "q"), (None, "v", "q")], "page_id long, url string, html string")
    assert sorted((r.url, r.record_type, r.refers_to) for r in warc.capture_histories(nameless).collect()) == [("", "response", None), ("http://a.org/1", "revisit", 3), ("u", "response", None), ("v", "response", None)]


def test_warc_members_can_be_sought(spark, tmp_path):
    rnd = random.Random(8)
    pages = [(k, f"http://h{k % 7}.org/{k} x", "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4000)))) for k in range(300)] + [(1000, "http://long.org", "long" * (5 << 20))]
    pages += [(2000 + k, "http://again.org", pages[3][2]) for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(df, path, archive_bytes=100_000)
    rows = warc.read_archives(spark, path).collect()
    texts, names = {p: h for p, _, h in pages}, set()
    assert len(rows) == len(pages) and len({r.archive for r in rows}) > 4
    for r in rows:
        with open(f"{path}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            data = gzip.decompress(f.read(r.length))
        head, block = warc.parse(data)
        names.add(head["WARC-Record-ID"])
        assert head["X-Page-ID"] == str(r.page_id) and block.startswith(b"HTTP/1.1 200 OK")
        assert r.payload.decode() == (texts[r.page_id] if r.record_type == "response" else "")
    assert len(names) == len(pages)
    for archive in {r.archive for r in rows}:
        own = [warc.parse(data)[0]["WARC-Type"] for _, _, data in warc.members_of((tmp_path / "archives" / archive).read_bytes()) if data]
        assert own[0] == "warcinfo" and own.count("warcinfo") == 1


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(12):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_nearest(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3000, 16)).astype(np.float32)
    x[500:560] = x[0]  # a class of equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0, None]), (9400, []), (0, x[0].tolist())]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), enough=600, block=700).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(3000), d)) if j != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-9 for _, v, s in found)
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in got[0]] == list(range(500, 510))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(docs, texts, empty):
    got = sharding.reshard(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 7).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(texts, key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 7 and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.reshard(empty, F.lit(0), 7).count() == 0


def test_reshard_query(spark, docs, texts, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_reshard(spark, str(tmp_path)).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(want, key=str)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and {r.shard for r in got} == set(range(40))


def test_only_changed_files_are_written(spark, tmp_path):
    rows = [(k, "x" * (k % 50)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = str(tmp_path / "first")
    sharding.reshard(docs, F.pmod("doc_id", F.lit(8)), 8, first)
    layout = {k: f"{first}/shard={k}" for k in range(8)}
    same = sharding.reshard_files(spark, layout, 8, str(tmp_path / "same"))
    assert same == layout and not (tmp_path / "same").exists()
    docs.where("doc_id < 50").coalesce(1).selectExpr("doc_id + 1000 AS doc_id", "text", "8 AS old_shard", "doc_id AS slot").write.parquet(str(tmp_path / "eighth"))
    more = sharding.reshard_files(spark, layout | {8: str(tmp_path / "eighth")}, 9, str(tmp_path / "more"))
    assert more == layout | {8: str(tmp_path / "eighth")}
    fewer = sharding.reshard_files(spark, layout, 7, str(tmp_path / "fewer"))
    grown = sharding.reshard_files(spark, layout, 10, str(tmp_path / "grown"))
    for now, n in ((fewer, 7), (grown, 10)):
        out = sharding.read_layout(spark, now).collect()
        assert sorted((r.doc_id, r.text) for r in out) == rows
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        counts = [len(v) for v in slots.values()]
        assert len(counts) == n and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.reshard_files(spark, {}, 3, str(tmp_path / "none")) == {}


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(4)
    for _ in range(60):
        old, new = rnd.randint(1, 3), rnd.randint(1, 4)
        blocks = [(i, c, n, n * (c + 1)) for i in range(old) for c in range(3) if (n := rnd.randint(0, 4))]
        moves = sharding.plan(blocks, old, new)
        total = sum(n for _, _, n, _ in blocks)
        held = Counter()
        for _, _, j, n in moves:
            held[j] += n
        assert sum(held.values()) == total and max(held[j] for j in range(new)) - min(held[j] for j in range(new)) <= 1
        cost = sum(n * (c + 1) for i, c, j, n in moves if i != j)
        # the least cost: each way to give some shards one row more, each old shard sending its smallest rows
        least, more = divmod(total, new)
        import itertools

        best = None
        for extra in itertools.combinations(range(new), more):
            room = [least + (j in extra) for j in range(new)]
            own = 0
            for i in range(old):
                sizes = sorted(c + 1 for k, c, n, _ in blocks if k == i for _ in range(n))
                own += sum(sizes[: max(0, len(sizes) - (room[i] if i < new else 0))])
            best = own if best is None else min(best, own)
        assert cost == best


def brute_licenses(text, least=0.8):
    """(dice, name) of every unit and window, without any pruning."""
    known, out = license.templates(), []
    grams = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    dice = lambda g, t: 2 * len(set(g) & set(t.bigrams)) / (len(set(g)) + len(t.bigrams))
    lines = (text or "").split("\n")
    for unit in lines + ([text] if len(lines) > 1 else []):
        out += [(dice(g, t), t.name) for t in known if (g := grams(license.normal_words(unit)))]
    pairs = grams(license.normal_words(text or ""))
    for t in known:
        for first in {k - place for gram, place in t.anchors() for k, g in enumerate(pairs) if g == gram}:
            out.append((dice(pairs[max(first, 0) : first + len(t.words) - 1], t), t.name))
    return [x for x in out if x[0] >= least]


def test_license(spark, docs, empty):
    import textwrap

    con, rnd = duckdb.connect(), random.Random(6)
    rows = [(1, "Some text\nReleased under the MIT License.\nmore"), (2, "licensed UNDER the Apache-License, version 2.0"), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (5, "x"), (None, "MIT")]
    rows += [(100 + k, t) for k, t in enumerate(some_texts())]
    prose = lambda n: " ".join(rnd.choice(["plain", "words", "of", "software", "the", "license"]) for _ in range(n))
    wanted = {}
    for k, (name, texts) in enumerate(license.WHOLE_TEXTS.items()):
        for j, text in enumerate(texts):
            body = textwrap.fill(text, 60)
            rows.append((1000 + 10 * k + j, f"Copyright 2020\n\n{body}\n\nint main() {{}}"))
            rows.append((2000 + 10 * k + j, f"{prose(300)}\n * " + body.replace("\n", "\n * ") + f"\n{prose(400)}"))
            wanted |= {1000 + 10 * k + j: name, 2000 + 10 * k + j: name}
            words = text.split()
            for m in range(3):  # some words changed or left out
                rows.append((3000 + 100 * k + 10 * j + m, " ".join(w if rnd.random() > 0.04 * m else rnd.choice(["", "changed"]) for w in words)))
    rows.append((9000, "This project is released under the MIT License, see LICENSE. " + "x" * 60_000))
    wanted[9000] = "MIT"
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, found string")
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"})[["doc_id", "text"]])
    got = [tuple(r) for r in license.license_scan(df).collect()]
    want = con.sql(license.oracle_sql()).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {g[0]: g[4] for g in got if g[4] and g[0] < 100} == {1: "MIT", 2: "Apache-2.0", 5: "CC-BY-NC-4.0"}
    assert {g[0]: g[4] for g in got if g[0] in wanted} == wanted
    brute = [(d, brute_licenses(x)) for d, x in rows]
    assert sorted(((g[0], g[2], g[3]) for g in got), key=str) == sorted(((d, len(x), ",".join(sorted({n for _, n in x}))) for d, x in brute), key=str)
    tied = license.license_scan(df.where("doc_id = 1"), texts={"B": ["released under the mit license"], "A": ["Released under the MIT license!"]}).first()
    assert (tied.best_license, tied.licenses) == ("A", "A,B")
    assert license.license_scan(empty).count() == 0


def test_telling_words_are_needed():
    telling = set(license.telling_words(license.templates(), 0.8))
    for t in license.templates():
        left = [g for g in t.bigrams if not set(g.split()) & telling]
        assert 2 * len(left) / (len(left) + len(t.bigrams)) < 0.8 and t.anchors()


def test_pipeline(spark, docs, texts):
    at, rows = docs.drop("key", "shard", "row", "members"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, "")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == at.columns
            at = common.materialize(out, name)
        rows.append(out.count())
    kept = Counter(r.doc_id for r in at.collect())
    good = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert rows[0] == rows[1] > rows[2] == rows[3] and set(kept) <= good
    near = [(d, s) for d, s in sets_of([(r.doc_id, r.text) for r in at.collect()], 5)]
    assert rows[2] and not any(100 * len(a & b) >= 80 * len(a | b) for i, (x, a) in enumerate(near) for y, b in near[i + 1 :] if x != y and a and b and not any("[" in str(w) for w in a | b))


def test_registered():
    names = queries.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 11 and set(queries.oracle_sql()) <= set(names)


def test_words_of_arrow_texts():
    """Texts as an Arrow array, also a slice, give the library's ids, whatever white space they hold."""
    words, odd = packing.loaded(WORD), ["skipped", "", " ", "\n\na  b\t", "a b c d", "x\x1cy\x85z", "word, Word. ... café; é", "\x0b\x0cend"]
    for texts in (pa.array(odd)[1:], pa.array(odd[:1])[1:]):
        got = words.encode_batch(texts)
        assert [g.tolist() for g in got] == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts.to_pylist()]
