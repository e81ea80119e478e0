"""Each operator against a plain version over texts that hold all the edge cases, and on empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from edge_texts import BENCHMARK, TEXTS
from pyspark.sql import functions as F

from glyphsieve.llm import decontaminate, licences, pieces, pii, quality, repeats, sharding, simhash, token_counts, token_files, transducer
from glyphsieve.llm.common import tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_decontamination(docs, benchmark, nothing):
    items = [(str(i), WORD.findall(lower(t))) for i, t in set(BENCHMARK) if i is not None]
    expected = Counter()
    for doc_id, text in TEXTS:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for name, item in items:
            for w in range(max(1, len(item) - 9)) if item else ():
                window = item[w : w + 10]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        names.add(name)
        expected[doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    found = decontaminate.digest(decontaminate.decontaminate(docs, benchmark))
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    assert sum(n for k, n in expected.items() if k[5]) > 2
    assert decontaminate.digest(decontaminate.decontaminate(nothing, benchmark)).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(docs, benchmark.limit(0))).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one x x x x two"), (3, "two one")], "doc_id long, text string")
    terms, vocabulary = decontaminate.benchmark_terms(spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    index = decontaminate.build_index(docs, vocabulary)
    queries = terms.join(vocabulary, "term").select(F.lit(1).alias("query_id"), "term_id")
    ends = index.filter("term_id = 0").select("key", "doc_id")
    near = lambda span: {r["doc_id"] for r in decontaminate.proximity_matches(index, queries, span).join(ends, "key").collect()}
    assert near(1) == {1, 3} and near(5) == {1, 2, 3}


def test_simhash(docs, nothing):
    def fp(text):
        w = PLAIN.findall(lower(text))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fp(t)) for i, t in TEXTS]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None), default=None) for g in set(group)}
    expected = Counter((d, f"{f:016x}", low[group[k]]) for k, (d, f) in enumerate(prints))
    assert rows_of(simhash.digest(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.digest(nothing).count() == 0


def test_large_shards_lose_no_link(spark):
    """Shards far beyond their limit are dealt again, and still join all that is within the radius."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 62, 3)
    values = sorted({int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 5), replace=False)) for b in base for _ in range(150)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), limit=4)).collect()
    group = {v: v for v in signed}
    for r in found:
        group[r["node"]] = r["root"]
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                assert group[signed[i]] == group[signed[j]]
    assert len(set(group.values())) >= 3


def test_bk_tree_equals_brute_force():
    draw = np.random.default_rng(1)
    values = [int(x) for x in draw.integers(0, 1 << 16, 400)]
    tree = simhash.BKTree(3)
    for x in values:
        near = tree.joined(x)
        brute = {tree.find(i) for i, y in enumerate(tree.nodes) if (x ^ y).bit_count() <= 3}
        assert {tree.find(i) for i in near} == brute
        tree.insert(x, near)


def test_near_duplicates(spark):
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    base = [[words[k] for k in draw.integers(0, 5000, 300)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        changed = list(b)
        changed[150] = "new"  # 5 of some 300 shingles
        rows.append((100 + i, " ".join(changed)))
        rows.append((200 + i, " ".join(b)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert all(found[100 + i] == found[200 + i] == found[i] == i for i in range(30))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_near_duplicates_of_a_table(spark):
    """Every pair of documents of the sf0.01 table whose five-word shingles have a Jaccard similarity of 0.8 or more is in one class."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = {r["doc_id"]: simhash.shingle_hashes((r["text"] or "").encode(), 5) for r in rows.collect()}
    prints = {d: [simhash.majority(simhash.mixed(h, k)) for k in range(4)] for d, h in held.items()}
    sets = {d: set(h.tolist()) for d, h in held.items() if len(h)}
    names = sorted(sets)
    pairs = []
    for i, a in enumerate(names):
        for b in names[:i]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 5 * low >= 4 * high and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    joined = [found[a] == found[b] for a, b in pairs]
    assert len(pairs) > 50 and sum(joined) >= 0.9 * len(pairs)
    near = [(a, b) for a, b in pairs if sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= 51]
    assert all(found[a] == found[b] for a, b in near)


def test_hot_keys_lose_no_near_copy(spark):
    """A chain of near copies that share a key, where trees hold a few nodes: each is within the radius of its neighbours only."""
    draw = np.random.default_rng(5)
    chains, values = [], []
    for _ in range(2):
        chain = [int.from_bytes(draw.bytes(32), "little")]
        for at in range(0, 250, 10):
            chain.append(chain[-1] ^ (1023 << at))
        chains.append(chain)
        values += chain
    rows = [(7, values[i].to_bytes(32, "little")) for i in draw.permutation(len(values))]
    for limit in (4, 8, 1000):
        group = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(spark.createDataFrame(rows, "key long, fp binary"), 10, limit)).collect()}
        classes = [{bytes(group.get(v.to_bytes(32, "little"), v.to_bytes(32, "little"))) for v in chain} for chain in chains]
        assert [len(c) for c in classes] == [1, 1] and classes[0] != classes[1]


def test_near_duplicates_of_every_length(spark):
    """Against brute force, from 10 words on: what is alike in shingles and in fingerprints is in one class, frequent shingles or not."""
    draw = np.random.default_rng(4)
    texts = []
    for size in (10, 11, 13, 16, 20, 25, 28, 40, 70, 200):
        for k in range(24):
            words = [f"w{i}" for i in draw.integers(0, 50_000, size)]
            line = [f"line{i}" for i in range(8)] if k % 4 == 0 else []
            texts += [[*words, *line], [*words, "more", *line], [*words[:-1], "other", *line], ["new", *words[1:-1], "end", *line]]
    texts = [" ".join(t) for t in texts]
    hashes = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    prints = [sum(simhash.majority(simhash.mixed(h, k)) << 64 * k for k in range(4)) for h in hashes]
    sets = [set(h.tolist()) for h in hashes]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (prints[i] ^ prints[j]).bit_count() <= 51]
    short = [p for p in pairs if len(texts[p[0]].split()) < 20]
    assert len(pairs) > 500 and len(short) > 100
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not [p for p in pairs if found[p[0]] != found[p[1]]]
    frequent = np.unique(np.concatenate([simhash.shingle_hashes(b" ".join(b"line%d" % i for i in range(8)), 5), *hashes[:8]]))
    for order in (np.arange(len(frequent)), np.arange(len(frequent))[::-1]):
        keys = [set(simhash.prefix_keys(h, frequent, order).tolist()) for h in hashes]
        assert all(keys[i] & keys[j] for i, j in pairs)


def test_token_files(spark, docs, nothing, tmp_path):
    path = tokenizer(token_files.MODEL)
    library = token_files.words(path).tokenizer
    exact = {}
    for doc_id, text in TEXTS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        exact.setdefault(doc_id, Counter())[len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = token_files.digest(docs, path).collect()
    assert sum(len(list(c.elements())) for c in exact.values()) == len(rows)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], Counter())[r["n_tokens"], r["ids_crc32"]] += 1
    assert got == exact
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1])
    assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(r["doc_id"] for r in ordered if r["doc_id"] is not None)
    assert token_files.digest(nothing, path).count() == 0
    index = token_files.write_indexed(docs, str(tmp_path / "f"), path)
    first = token_files.shuffled(index, 7).first()
    name = next(p for p in (tmp_path / "f/records").iterdir() if p.name.startswith(f"part-{first['file']:05d}"))
    payload, _ = token_files.read_at(name.read_bytes(), first["offset"])
    assert token_files.unpack(payload)[0] == first["doc_id"]
    spoiled = bytearray(name.read_bytes())
    spoiled[first["offset"] + 20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_at(bytes(spoiled), first["offset"])


def test_quality(docs, nothing):
    expected = Counter()
    for doc_id, text in TEXTS:
        text = text or ""
        words = PLAIN.findall(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if PLAIN.search(x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    found = quality.digest(docs, tokenizer(quality.MODEL))
    assert rows_of(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert found.filter("base_failed AND kept").count() == 0
    library = pieces.model(tokenizer(quality.MODEL)).library
    text = TEXTS[91 - 1][1]
    measured = found.filter("doc_id = 90").first()
    assert measured["n_tokens"] == len(library.encode(next(t for i, t in TEXTS if i == 90))) and text is not None
    kept = quality.keep(docs, tokenizer(quality.MODEL))
    assert kept.columns == docs.columns and kept.count() == found.filter("kept").count()
    assert quality.digest(nothing, tokenizer(quality.MODEL)).count() == 0
    assert quality.script("日本語です漢字") in ("kana", "han") and quality.script("") == "other" and quality.script("Привет") == "cyrillic"


def test_fertility_figures(docs):
    """Characters per token, byte share and entropy from the library's own ids."""
    path = tokenizer(quality.MODEL)
    library = pieces.model(path).library
    for r, text in ((r, t) for r in quality.measure(docs, path).collect() for i, t in TEXTS if i == r["doc_id"] and i not in (None, 85)):
        ids = library.encode(text or "")
        assert r["n_tokens"] == len(ids)
        if not ids:
            assert r["chars_per_token"] is None and r["entropy"] is None and r["byte_share"] is None
            continue
        fallback = sum(library.is_byte(i) and library.id_to_piece(i) not in ("<0x0A>", "<0x0D>", "<0x09>") for i in ids)
        p = np.array(list(Counter(ids).values())) / len(ids)
        assert math.isclose(r["chars_per_token"], len(text) / len(ids)) and math.isclose(r["byte_share"], fallback / len(ids))
        assert math.isclose(r["entropy"], -(p * np.log2(p)).sum(), abs_tol=1e-9)


class Counted:
    """A library that counts its calls."""

    def __init__(self, library):
        self.library, self.calls = library, 0

    def encode(self, *args, **named):
        self.calls += 1
        return self.library.encode(*args, **named)


def rare_texts():
    """Texts of words that no memo holds, and odd ones."""
    draw = random.Random(8)
    rare = [" ".join("".join(draw.choice("abcdeéß日本語😀$▁.,") for _ in range(draw.randint(1, 12))) for _ in range(500)) for _ in range(6)]
    return [t or "" for _, t in TEXTS] + rare + ["日本語" * 3000, "aB" * 3000 + "\n\n" + "é ", "\n", "▁", " ", "<0x0A> \r\n\t"]


@pytest.mark.parametrize("operator", ["quality", "token_counts"])
def test_library_is_asked_for_many_pre_tokens_at_once(monkeypatch, operator):
    """However many pre-tokens the memo lacks, a few calls."""
    m = pieces.PieceModel(tokenizer(quality.MODEL))
    texts = rare_texts()
    exact = m.library.encode(texts)
    m.library = Counted(m.library)
    if operator == "quality":
        monkeypatch.setattr(quality, "model", lambda path: m)
        monkeypatch.setattr(quality, "_cache", quality._cache.__wrapped__)
        assert [f[0] for f in quality.fertility(m.path, texts)] == list(map(len, exact))
    else:
        monkeypatch.setattr(token_counts, "model", lambda path: m)
        monkeypatch.setattr(token_counts, "_caches", {})
        cache = token_counts._counter(m.path, SimpleNamespace(value={}))
        assert pieces.counted([m.prepare(t) for t in texts], cache.all).tolist() == list(map(len, exact))
    assert m.library.calls < 100


def test_memos_of_every_size_give_the_same():
    m = pieces.PieceModel(tokenizer(quality.MODEL))
    texts = rare_texts()
    exact = m.library.encode(texts)
    prepared = [m.prepare(t) for t in texts]
    for entries in (1, 7, 1000, 100_000):
        packed = pieces.Cache(m, lambda t: np.array(m.encode(t), "<u2").tobytes(), b"".join, entries=entries, many=lambda ts: m.packed(ts, "<u2"))
        lengths = pieces.Cache(m, lambda t: len(m.encode(t)), sum, entries=entries, many=m.lengths)
        for _ in range(2):
            ids, ends = pieces.encoded(prepared, packed.all, "<u2")
            assert [x.tolist() for x in np.split(ids, ends[1:-1])] == exact
            assert pieces.counted(prepared, lengths.all).tolist() == list(map(len, exact))
            assert len(packed) <= entries + 1 and len(lengths) <= entries + 1
    m.unigram = True  # each alone
    assert m.packed(["", "▁the", "日本"], "<u2") == [np.array(m.encode(t) if t else [], "<u2").tobytes() for t in ("", "▁the", "日本")] and m.lengths([]) == []


def plain_fences(rows):
    """(chars_low, chars_high, bits_low, bits_high) of each group, by sorting."""
    groups = {}
    for r in rows:
        if not r["base_failed"] and r["n_tokens"]:
            size = int(math.log2(r["n_tokens"]))
            groups.setdefault((r["script"], r["language"], size, "chars"), []).append(math.floor(r["chars_per_token"] * quality.STEPS))
            groups.setdefault((r["script"], r["language"], size, "bits"), []).append(math.floor(r["entropy"] * quality.STEPS))
            if r["n_tokens"] >= quality.LONG_TOKENS:
                groups.setdefault((r["script"], r["language"], -1, "chars"), []).append(math.floor(r["chars_per_token"] * quality.STEPS))
    out = {}
    for key, steps in groups.items():
        if len(steps) >= quality.GROUP:
            low, high = ((sorted(steps)[-(-k * len(steps) // 4) - 1] + 0.5) / quality.STEPS for k in (1, 3))
            reach = max(quality.REACH * (high - low), quality.LEAST_REACH * (high + low) / 2)
            out[key] = low - reach, high + reach
    return out


def test_fertility_rejects_what_the_base_rules_keep(spark):
    """Base64, random letters, symbols in words and wrongly decoded text go; clean texts of four languages and rare groups stay."""
    draw = random.Random(3)
    source = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("n_chars BETWEEN 500 AND 4000").orderBy("doc_id").select("doc_id", "text", "lang").limit(1600).collect()
    good = [(r["doc_id"], r["text"], r["lang"]) for r in source]
    junk, english = [], [t for _, t, lang in good if lang == "en"]
    for k in range(12):
        text = english[7 * k]
        coded = base64.b64encode(text.encode()).decode()
        junk += [" ".join(coded[i : i + 60] for i in range(0, len(coded), 60)), " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in text.split())]
        junk += [" ".join(w + draw.choice("#$%&") * 3 for w in text.split()), text.encode("utf-16-le").decode("latin-1")]
    rows = good + [(10_000_000 + i, t, "en") for i, t in enumerate(junk)] + [(20_000_000, "Привет, как дела? " + " ".join(f"слово{i}" for i in range(30)), "ru")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = quality.digest(table, tokenizer(quality.MODEL)).collect()
    fences = plain_fences(found)
    for r in found:
        if r["n_tokens"]:
            size = int(math.log2(r["n_tokens"]))
            least, most, share, bits = quality.BANDS[r["script"]]
            ok = least <= r["chars_per_token"] <= most and r["byte_share"] <= share and (r["entropy"] >= bits or r["n_tokens"] < quality.ENTROPY_TOKENS)
            chars = fences.get((r["script"], r["language"], size, "chars")) or (fences.get((r["script"], r["language"], -1, "chars")) if r["n_tokens"] >= quality.LONG_TOKENS else None)
            entropy = fences.get((r["script"], r["language"], size, "bits"))
            ok = ok and (not chars or chars[0] <= r["chars_per_token"] <= chars[1]) and (not entropy or entropy[0] <= r["entropy"] <= entropy[1])
            assert r["fertile"] == ok and r["kept"] == (ok and not r["base_failed"])
    by = {r["doc_id"]: r for r in found}
    bad = [by[10_000_000 + i] for i in range(len(junk))]
    assert sum(not r["base_failed"] for r in bad) >= 0.7 * len(bad) and not any(r["kept"] for r in bad)
    assert by[20_000_000]["kept"]
    marks = re.compile(r"[#$%&*]{3}|\|")
    clean = [by[i] for i, t, _ in good if not marks.search(t) and not by[i]["base_failed"]]
    assert len(clean) > 1000 and sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_licences(docs, nothing):
    expected = Counter()
    for doc_id, text in TEXTS:
        words = WORD.findall(lower(text))
        places = [(i, label) for phrase, label in licences.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        expected[doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    found = licences.digest(docs)
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in found.collect())
    assert licences.digest(nothing).count() == 0


def test_matching_statistics():
    texts = [[1, 2, 3, 1, 2], [2, 3, 4], [5, 1, 2, 3, 4, 4]]
    machine = licences.Automaton(texts)
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    draw = np.random.default_rng(0)
    for _ in range(200):
        stream = draw.integers(1, 7, 30).tolist()
        for at, (state, length) in enumerate(machine.statistics(stream)):
            longest = max((n for n in range(1, at + 2) if tuple(stream[at + 1 - n : at + 1]) in held), default=0)
            assert length == longest
            for t, end in machine.ends[state] if length else ():
                assert texts[t][end - length + 1 : end + 1] == stream[at + 1 - length : at + 1]


def test_long_licence_is_chained():
    label, text = licences.TEMPLATES[2]
    words = ("so then " + text.replace("sublicense", "and then sublicense") + " and on").encode().split()
    _, spans = licences.scanner().scan(words)
    assert [s[0] for s in spans] == [label] and spans[0][1] == 2 and spans[0][4] > 0.9


def test_token_counts(docs, nothing):
    path = tokenizer(token_counts.MODEL)
    library = pieces.model(path).library
    expected = Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > token_counts.LIMIT) for i, t in TEXTS)
    assert rows_of(token_counts.digest(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.digest(nothing, path).count() == 0


def test_sharding(docs, nothing):
    rows = sharding.digest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert sharding.feistel(r["row_number"], len(rows)) == r["slot"] * 16 + r["shard"]
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.digest(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 99, 1000])
def test_feistel_is_a_permutation(spark, n):
    out = [sharding.feistel(x, n) for x in range(n)]
    assert sorted(out) == list(range(n)) and all(sharding.inverse(y, n) == x for x, y in enumerate(out))
    assert [r["p"] for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).orderBy("id").collect()] == out


def plain_repeats(texts):
    first, out = {}, Counter()
    grams = [[(t or "").encode()[p : p + 50] for p in range(len((t or "").encode()) - 49)] for _, t in texts]
    for (doc_id, _), own in zip(texts, grams, strict=True):
        for g in own:
            key = repeats.NULL_ID if doc_id is None else doc_id
            first[g] = min(first.get(g, key), key)
    for (doc_id, text), own in zip(texts, grams, strict=True):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p, g in enumerate(own):
            if first[g] < (repeats.NULL_ID if doc_id is None else doc_id):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc_id, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [repeats.HOT, 2])
def test_repeats(docs, most):
    """Also with every shared key taken for a hot one."""
    found = repeats.remove_repeats(docs, texts=False, most=most)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_repeats(TEXTS)


def test_long_texts_and_slices(spark, monkeypatch):
    """Texts longer than a slice and than a block, endless repetition, strings that end in one slice and go on in the next."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7)))
    long = " ".join(word() for _ in range(1500))
    texts = [(1, long), (2, "x" + long), (3, long[700:2400] + " y " + long[100:900]), (4, "ab" * 900), (5, "ab" * 700 + "c"), (6, "ab" * 20 + long[-60:]), (None, long[5:300]), (7, None), (7, "")]
    monkeypatch.setattr(repeats, "PIECE", 173)
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    monkeypatch.setattr(repeats, "GIVEN", 100)
    offsets = np.cumsum([0, *(len(t or "") for _, t in texts)])
    raw = "".join(t or "" for _, t in texts).encode()
    keys = {}
    for start, count, key in zip(*(x.tolist() for x in repeats.runs(memoryview(raw), offsets)), strict=True):
        for p in range(start, start + count):
            assert keys.setdefault(raw[p : p + 50], key) == key
    assert set(keys) == {raw[p : p + 50] for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in range(a, b - 49)}
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for most in (repeats.HOT, 2):
        # The mapped functions run in this process, under the small sizes.
        assert block_by_block(texts, most) == plain_repeats(texts)
    found = repeats.remove_repeats(rows, texts=False)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_repeats(texts)


def block_by_block(texts, most, bits=2):
    """The steps of remove_repeats over one block per text, in plain loops."""
    blocks = [((i if i is not None else repeats.NULL_ID), i, (t or "").encode()) for i, t in texts]
    weights, seen = Counter(), Counter()
    for _, _, raw in blocks:
        _, count, keys = repeats.runs(raw, np.array([0, len(raw)]))
        ids, _, w = repeats.weighed(keys, count, bits)
        weights.update(dict(zip(ids.tolist(), w.tolist(), strict=True)))
        seen.update(ids.tolist())
    cuts, buckets = [], {}
    for n, (key, _, raw) in enumerate(blocks):
        offsets = np.array([0, len(raw)])
        ids, _, _ = repeats.weighed(*(repeats.runs(raw, offsets)[k] for k in (2, 1)), bits)
        answers = {}
        for bucket, a, b in repeats._by_bucket(ids, bits):
            own = ids[a:b].tolist()
            answers[bucket] = np.packbits([seen[i] > 1 for i in own] + [weights[i] >= most for i in own]).tobytes()
        cut = repeats.Cut(raw, offsets, np.array([key]), answers, bits)
        sent = np.flatnonzero(cut.sent)
        sent = sent[np.argsort(cut.seg_id[sent], kind="stable")]
        parts = list(repeats._by_bucket(cut.seg_id[sent], bits))
        cuts.append((cut.state(sent, parts), offsets))
        for bucket, a, b in parts:
            own = sent[a:b]
            buckets.setdefault(bucket, []).append((n, cut.seg_id[own].astype(np.uint32), cut.positions[own].astype(np.int64), cut.least[own], b"".join(raw[x : x + p + 49] for x, p in zip(cut.at[own].tolist(), cut.positions[own].tolist(), strict=True))))
    replies = [{} for _ in blocks]
    for bucket, rows in buckets.items():
        flags = repeats.settle(*(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3)), b"".join(r[4] for r in rows))
        at = 0
        for n, _, positions, _, _ in rows:
            replies[n][bucket] = np.packbits(flags[at : at + int(positions.sum())]).tobytes()
            at += int(positions.sum())
    out = Counter()
    for (_, i, raw), (state, offsets), reply in zip(blocks, cuts, replies, strict=True):
        low, high, _ = repeats.removed_spans(repeats.unpack(state), reply, offsets)
        gone = set()
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            gone |= set(range(a, b))
        out[i, len(raw), len(gone), len(low), hashlib.sha256(bytes(x for k, x in enumerate(raw) if k not in gone)).hexdigest()] += 1
    return out


def test_segments_of_one_hash(monkeypatch):
    """Hashes that meet by chance are told apart byte by byte."""
    contents = repeats.contents
    monkeypatch.setattr(repeats, "contents", lambda raw, start, count: repeats.mix(contents(raw, start, count) % np.uint64(7)))
    assert block_by_block(TEXTS[55:82], 2) == plain_repeats(TEXTS[55:82])


MEMORY = """
import resource, numpy as np
from glyphsieve.llm import repeats
draw = np.random.default_rng(0)
words = [bytes(draw.integers(97, 123, draw.integers(2, 9), dtype=np.uint8)) for _ in range(5000)]
raw = b" ".join(words[k] for k in draw.integers(0, 5000, {size} // 6))[:{size}]
offsets = np.append(np.arange(0, len(raw), {text}), len(raw))
_, count, keys = repeats.runs(raw, offsets)
ids, _, _ = repeats.weighed(keys, count, 6)
answers = {{b: np.packbits(np.concatenate([np.ones(y - x, bool), np.full(y - x, {hot})])).tobytes() for b, x, y in repeats._by_bucket(ids, 6)}}
del count, keys, ids
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
cut = repeats.Cut(raw, offsets, np.arange(len(offsets) - 1), answers, 6)
none = np.empty(0, np.int64)
repeats.removed_spans(repeats.unpack(cut.state(none, [])), {{}}, offsets)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize(("size", "text", "hot", "most"), [(8 << 20, 2000, True, 600), (8 << 20, 2000, False, 150), (20 << 20, 20 << 20, False, 300)])
def test_memory_of_a_block(size, text, hot, most):
    """MB that a worker takes beyond the block: all keys hot, all keys shared, one text of 20 MB."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", MEMORY.format(size=size, text=text, hot=hot)], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < most


def test_sizes_follow_the_input():
    assert repeats.sizes(10**8, 12) == (repeats.BLOCK, 6, 12)
    block, bits, parts = repeats.sizes(10**14, 4000)
    assert block == 8 * repeats.BLOCK and 1 << bits <= 1 << 19 and parts == repeats.MOST_PARTS


def test_repeats_of_nothing(spark, nothing):
    assert repeats.digest(nothing).count() == 0
    short = [(1, "short"), (2, "short"), (3, None)]
    found = repeats.remove_repeats(spark.createDataFrame(short, "doc_id long, text string"), texts=False)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_repeats(short)


def test_suffix_array():
    draw = np.random.default_rng(4)
    for k in (1, 2, 3, 30):
        for _ in range(60):
            text = np.append(draw.integers(1, k + 1, draw.integers(1, 150)), 0).astype(np.uint16)
            text[np.flatnonzero(draw.random(len(text)) < 0.05)[:-1]] = 0
            text[-2:] = [1, 0] if len(text) > 1 else [0]
            order = repeats.suffix_array(text, 1000).tolist()
            assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())
            prefix = repeats.common_prefixes(text, np.array(order), 1000).tolist()
            for a, b, p in zip(order, order[1:], prefix[1:], strict=False):
                x, y = text[a:].tolist(), text[b:].tolist()
                assert p == next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_pii(docs, nothing):
    expected = Counter()
    for doc_id, text in TEXTS:
        found = plain_spans(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        expected[doc_id, *[sum(k == kind for k, _, _ in found) for kind in pii.KINDS], digest] += 1
    rows = pii.digest(docs)
    assert rows_of(rows, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected
    # Upper-case digits are no seed; what stands before lower-case ones gives them away.
    assert rows.filter("doc_id = 101").first()["spans"] == "secret:9:49"
    assert pii.digest(nothing).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.filter("doc_id = 90").first()["text"]
    assert "<EMAIL>" in text and "<IP>" in text and "<CARD>" in text and "<PHONE>" in text and "300.1.1.1" in text and "@" not in text


def test_pii_edges():
    draw = np.random.default_rng(6)
    parts = [*"ab.@-+%_ 01259()", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 555-1234", "é"]
    for _ in range(3000):
        text = "".join(parts[k] for k in draw.integers(0, len(parts), draw.integers(0, 50)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 50_000 + "@" * 1000) == [] and pii.emails("x" * 5000 + "@a.b") == [(0, 5004)]


def test_transducer(docs, nothing):
    path = tokenizer(transducer.MODEL)
    library = pieces.model(path).library
    expected = Counter()
    for doc_id, text in TEXTS:
        ids = library.encode(text or "")
        expected[doc_id, tuple(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    rows = transducer.digest(docs, path).withColumn("ids", F.col("ids"))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_crc32"], r["decoded_sha256"]) for r in rows.collect()) == expected
    assert transducer.digest(nothing, path).count() == 0


def test_transducer_paths():
    """Runs of spaces and every piece of the vocabulary alone and before a common one, as the library encodes them."""
    path = tokenizer(transducer.MODEL)
    t, _ = transducer.machine(path)
    library = t.pieces.library
    texts = [" " * k + tail for k in range(1, 40) for tail in ("", "a", "\n", "▁")] + [p.replace("▁", " ") for p in list(t.pieces.ids)[::7]] + [p + "ation" for p in list(t.pieces.ids)[::11]]
    assert [x.tolist() for x in transducer.ids_of(path, texts)] == [library.encode(x) for x in texts]


def test_queries_at_the_smallest_scale(spark):
    from glyphsieve.llm import queries

    for name, query in queries.QUERIES.items():
        assert query(spark, SF).count() == 200, name


def test_unigram_path_is_the_lightest():
    class Stub:
        unigram = True
        ids = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4, "bb": 5}
        scores = {0: -2.0, 1: -2.5, 2: -3.0, 3: -4.1, 4: -4.4, 5: -3.9}
        text = {i: p for p, i in ids.items()}
        pairs = {"ab", "ba", "bb"}
        byte_id, byte_of = {}, {}

    machine = transducer.Transducer(Stub)

    def best(token):
        if not token:
            return 0.0
        return max((Stub.scores[Stub.ids[token[:n]]] + best(token[n:]) for n in (1, 2, 3) if token[:n] in Stub.ids and len(token) >= n), default=-1e9)

    draw = np.random.default_rng(8)
    for _ in range(200):
        token = "".join("ab"[k] for k in draw.integers(0, 2, 9))
        path = machine.path(token)
        assert "".join(Stub.text[i] for i in path) == token and abs(sum(Stub.scores[i] for i in path) - best(token)) < 1e-9


def test_patterns_of_later_generations(spark):
    """Cues before no seed are learned from what other patterns found, generation after generation; a mixed cue is not."""
    texts = [f"token: abcdef{k:010x}a" for k in range(25)] + [f"token: ZQX{k}001" for k in range(5)]
    texts += [f"ref: ZQX{k}001" for k in range(5)] + ["ref: ZQY7002"]
    texts += [f"badge: ZQX{k}001" for k in range(4)] + ["badge: ZQY7002", "badge: ZQZ8003"]
    texts += [f"page: ZQX{k}001" for k in range(3)] + [f"page: XYZ{k}009" for k in range(3)]
    texts += [f"room {1_000_000 + k}" for k in range(200)] + ["und +1 (234) 555-1234", "und a.b@c.de", "und 10.1.2.3", "und 7654321"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r["doc_id"]] for r in pii.digest(rows).collect() if r["spans"]}
    assert found == {t for t in texts if not t.startswith(("page", "room")) and t != "und 7654321"}


def plain_patterns(texts):
    """The kinds of accepted patterns by the rule as it is written, in plain dictionaries."""
    held = [(k, c, text[a:b]) for text in texts for k, a, b, c, _ in pii.candidates(text)]
    kind_of = {}
    for k, _, v in held:
        kind_of[v] = max(kind_of.get(v) or "", k or "") or None
    values = {}
    for _, cues, v in held:
        for c in cues:
            values.setdefault(c, set()).add(v)
    values = {c: v for c, v in values.items() if len(v) > 1}
    share = {k: (n + 1) / (len(kind_of) + 2) for k, n in Counter(kind_of.values()).items() if k}
    known = {(v, k): 1.0 for v, k in kind_of.items() if k}
    good = {}
    for _ in range(200):
        good = {}
        for c, own in values.items():
            for k, r in share.items():
                p = sum(known.get((v, k), 0) for v in own) / len(own)
                surprise = 0 if p <= r else p * math.log(p / r) + ((1 - p) * math.log((1 - p) / (1 - r)) if p < 1 else 0)
                if p >= pii.ACCEPT and len(own) * surprise >= math.log(len(values) / pii.CHANCE):
                    good[c, k] = p
        for (c, k), p in good.items():
            for v in values[c]:
                if not kind_of[v]:
                    known[v, k] = max(known.get((v, k), 0), p)
    return good


def test_learned_spans(spark):
    """All spans against the rule in plain Python: both sides, several words, three coincidences."""
    draw = np.random.default_rng(9)
    texts = [f"reach me at a{k}.b@example.org today" for k in range(30)] + ["reach me at office(at)example123 today"]
    texts += [f"{40 + k}.12.13.{k} is my address now" for k in range(30)] + ["2001-db8-77-1 is my address now"]
    texts += [f"pass word: {draw.integers(1 << 60):016x}f1 end" for k in range(20)] + ["pass word: ABCDEF99 end", "word: ZZZZZ8"]
    texts += [f"und 10.0.0.{k}" for k in range(3)] + ["und 1234567", "he +1 (555) 123-4567", "he +1 (555) 123-4568", "he +1 (555) 123-4569", "he 7654321"]
    texts += [f"number {k} of {k}5500{k}" for k in range(150)]
    good = plain_patterns(texts)
    assert {c for c, _ in good} >= {"LLme at ", "RR is my", "LLpass word: "} and not [c for c, _ in good if c in ("Lund ", "Lhe ")]
    expected = {}
    for i, text in enumerate(texts):
        spans = []
        for k, a, b, cues, _ in pii.candidates(text):
            best = max(((good[c, k], -ord(k[0]), k) for c in cues for k in {k for x, k in good if x == c}), default=None)
            if k or best:
                kind = k or best[2]
                spans.append((pii.KINDS.index(kind) if kind in pii.KINDS else 9, kind, a, b))
        expected[i] = ",".join(f"{k}:{a}:{b}" for _, k, a, b in sorted(spans))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.digest(rows).collect()} == expected
    found = {i for i, s in expected.items() if s}
    assert {texts.index(t) for t in texts if t.startswith(("2001", "pass word: ABC"))} <= found
    assert not found & {i for i, t in enumerate(texts) if t in ("und 1234567", "he 7654321") or t.startswith("number")}


def test_counts_beside_a_column_of_that_name(docs):
    path = tokenizer(token_counts.MODEL)
    found = token_counts.count(docs, path)
    assert [c for c in found.columns if c.lower() == "n_tokens"] == ["n_tokens"] and dict(found.dtypes)["n_tokens"] == "bigint" and found.count() == docs.count()
    with pytest.raises(ValueError, match="replace"):
        token_counts.count(docs, path, column="TEXT")


def test_file_sizes():
    assert token_files.file_bytes(30 << 30) == token_files.FILE_BYTES and token_files.file_bytes(10**14) == token_files.MOST_BYTES


def test_very_long_texts(spark):
    """Texts beyond the parts, chunks and slices that operators work in, each against the library."""
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    long = " ".join(draw.choice(words) for _ in range(450_000))
    spaced = "x" * 300_000 + "@a.bc " + "7" * 100_000
    rows = spark.createDataFrame([(1, long), (2, spaced), (3, long + " tail of its own")], "doc_id long, text string")
    assert len(long) > pieces.PART_CHARS and len(long.split()) > 65_536
    library = pieces.model(tokenizer(token_counts.MODEL)).library
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.digest(rows, tokenizer(token_counts.MODEL)).collect()}
    assert counts == {1: len(library.encode(long)), 2: len(library.encode(spaced)), 3: len(library.encode(long + " tail of its own"))}
    assert len({r["component_id"] for r in simhash.digest(rows.filter("doc_id != 2")).collect()}) == 1
    assert len({r["component_id"] for r in simhash.near_duplicates(rows).collect()}) == 2
    gone = {r["doc_id"]: r["n_removed"] for r in repeats.digest(rows).collect()}
    assert gone == {1: 0, 2: 0, 3: len(long)}
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(rows).collect()}
    assert spans[2] == "email:0:300005" and spans[1] == ""
    measured = {r["doc_id"]: r for r in quality.digest(rows, tokenizer(quality.MODEL)).collect()}
    assert measured[1]["n_words"] == 450_000 and measured[1]["n_tokens"] == counts[1]
