"""Quality rules, line dedup, similarity join, mixing and packing against brute force and odd inputs."""

import bisect
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievework.llm import line_dedup as line_module, token_ids
from sievework.llm.bytesets import shingle_sets
from sievework.llm.cuckoo import CuckooFilter
from sievework.llm.line_dedup import delete, empty_state, insert, kept_lines, line_dedup
from sievework.llm.mixing import MixSettings, mix, mixed_documents
from sievework.llm.ngram_join import JoinSettings, drop_near_copies, ngram_join, prefix_depth
from sievework.llm.oracle import oracle_sql
from sievework.llm.packing import PackSettings, best_fit_packing, configurations, pack_lengths
from sievework.llm.quality_rules import QualityRules, keep_good, quality_rules
from sievework.llm.queries import queries
from sievework.llm.token_ids import Encoder, default_tokenizer

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    cells = ", ".join(f'"{c}"' for c in order)
    assert plain(got.select(order).collect()) == plain(want.project(cells).fetchall())


def test_quality_of_odd_texts(odd, empty):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count() and quality_rules(empty).count() == 0
    by_text = {r["doc_id"]: r for r in rows}
    assert by_text[1]["n_words"] == 22 and not by_text[1]["base_failed"]
    assert by_text[2]["base_failed"] and by_text[2]["n_words"] == 0 and by_text[7]["word_chars"] == 0
    assert keep_good(odd).columns == odd.columns and keep_good(empty).count() == 0
    kept = sorted(r["doc_id"] for r in keep_good(odd, rules=QualityRules(max_host_rate=1.0)).collect())
    assert kept == sorted(r["doc_id"] for r in rows if not r["base_failed"])


def test_bad_host_takes_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(99)] + [(99, good, "bad")] + [(100 + i, good, f"h{i % 5}") for i in range(100)] + [(300, "short", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules(docs).filter("kept").collect()}
    assert kept == set(range(100, 200))


def brute_lines(rows, least=10):
    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    top, held = (1 << 63) - 1, defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(top if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = top if i is None else i
        left = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return plain(out)


def test_lines_of_odd_texts(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = line_dedup(odd).withColumnRenamed("_lines", "made")
    got = [(r["doc_id"], *r["made"]) for r in found.collect()]
    assert plain(got) == brute_lines(rows)
    assert line_dedup(empty).count() == 0


def test_lines_are_reversible(spark, documents):
    docs = documents.select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    state = insert(insert(empty_state(spark, 3), first), second)
    both = kept_lines(docs, state, digest_only=True).select("doc_id", "lines.*").collect()
    assert plain(both) == brute_lines(rows)
    back = delete(state, first.select("doc_id"))
    left = kept_lines(second, back, digest_only=True).select("doc_id", "lines.*").collect()
    assert plain(left) == brute_lines([r for r in rows if r[0] % 2])
    # Nothing is counted twice, and the filters hold what is left and can be filled again.
    again = insert(insert(back, first), first)
    same = kept_lines(docs, again, digest_only=True).select("doc_id", "lines.*").collect()
    assert plain(same) == brute_lines(rows)


def test_few_long_documents_fill_many_shards(spark, monkeypatch):
    """A shard holds about so many lines, whatever the number of documents."""
    rows = [(i, "\n".join([f"Line {j} of document {i}" for j in range(40_000)] + ["a line of all of them"])) for i in range(12)]
    states = []
    monkeypatch.setattr(line_module, "kept_lines", lambda docs, state, *more: states.append(state) or kept_lines(docs, state, *more))
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_only=True)
    assert plain((r["doc_id"], *r["lines"]) for r in found.collect()) == brute_lines(rows)
    shards = line_module._with_shard(states[0].counts, states[0].shards).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 480_001
    assert max(r["count"] for r in shards) < 250_000 and states[0].filters.count() == states[0].shards


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    made = CuckooFilter.load(CuckooFilter.of(hashes).dump())
    assert made.contains(hashes).all()
    assert made.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001
    made.delete(hashes[:10_000])
    assert made.contains(hashes[10_000:]).all() and made.contains(hashes[:10_000]).mean() < 0.01
    full = CuckooFilter(16)
    with pytest.raises(OverflowError):
        full.insert(hashes[:200])


def brute_join(rows, width=5, least=0.8):
    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    top = (1 << 63) - 1
    links = [[b for b in range(len(sets)) if b != a and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= least * len(sets[a][1] | sets[b][1])] for a in range(len(sets))]
    out = []
    for a, (i, _) in enumerate(sets):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        root = min(top if sets[x][0] is None else sets[x][0] for x in seen)
        out.append((i, None if root == top else root, len(links[a])))
    return plain(out)


def test_join_of_odd_texts(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert plain(ngram_join(odd).collect()) == brute_join(rows)
    assert ngram_join(empty).count() == 0 and drop_near_copies(empty).count() == 0
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 2, 3, None, 4, 5, 7, None, 8])


def brute_kept(rows):
    """(id, distinct words) of the rows that stay: one of each component, and all without words."""
    top, sets = (1 << 63) - 1, {}
    for i, text in rows:
        w = words(text)
        if w:
            sets[top if i is None else i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))] = text
    nodes, left = list(sets), [i for i, text in rows if not words(text)]
    todo, components = set(nodes), []
    while todo:
        group, open_ = [], [todo.pop()]
        while open_:
            a = open_.pop()
            group.append(a)
            near = {b for b in todo if len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1])}
            todo -= near
            open_ += near
        components.append(group)
    return components, left


def test_near_copies_of_missing_and_repeated_ids(spark):
    def text(n, change=None):
        w = [f"t{n}w{i}" for i in range(60)]
        return " ".join(w if change is None else [*w[:-1], change])

    rows = [(None, text(n)) for n in range(6)] + [(None, text(0)), (None, text(1, "x")), (None, text(9, "y")), (4, text(2, "z"))]
    rows += [(7, text(n)) for n in range(10, 14)] + [(7, text(10)), (8, text(11, "u")), (6, text(12, "v")), (9, text(9)), (7, None), (None, " "), (None, None)]
    rows += [(20, text(30)), (21, text(30)), (22, text(31))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in drop_near_copies(docs).collect()]
    components, left = brute_kept(rows)
    assert len(got) == len(components) + len(left)
    assert sorted(map(repr, left)) == sorted(repr(i) for i, t in got if not words(t))
    top = (1 << 63) - 1
    for group in components:
        shingles = {s for _, s in group}
        own = [i for i, t in got if words(t) and frozenset(tuple(words(t)[k : k + 5]) for k in range(56)) in shingles]
        smallest = min(i for i, _ in group)
        assert own == [None if smallest == top else smallest]
    assert plain(ngram_join(docs).collect()) == brute_join(rows)


def test_join_of_a_large_group_in_blocks(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i % 60}", *base[41:]])) for i in range(150)] + [(1000 + i, " ".join(f"q{i}{k}" for k in range(20))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(ngram_join(docs, settings=JoinSettings(block=16)).collect()) == brute_join(rows)


def test_prefix_is_shortened_until_the_recall():
    s = JoinSettings()
    depth = prefix_depth(s)
    assert 1 - (1 - s.threshold**depth) ** s.trees >= s.recall > 1 - (1 - s.threshold ** (depth + 1)) ** s.trees


def test_shingles():
    sets = list(shingle_sets(pa.array(["a b c d e f", None, "", "a b", "a  b\n", "a b c d e a b c d e"]), 5))
    assert [len(x) for x in sets] == [2, 0, 0, 1, 1, 5]
    assert (sets[3] == sets[4]).all() and sets[0][0] in sets[5] or sets[0][1] in sets[5]


def brute_targets(sizes):
    names = sorted({s for s, _ in sizes}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for t, n in sizes if t == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(own.values()), {}, set(names)
    while open_:
        left, share = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / share > 3 * own[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in open_}
            break
        target |= {s: 3 * own[s] for s in over}
        open_ -= set(over)
    return own, target


def test_mix_meets_its_targets(documents):
    rows = mix(documents).collect()
    sizes = [(r["source"], len(words(r["text"]))) for r in documents.collect()]
    own, target = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == own[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"] and abs(r["copies"] - r["rate"]) <= 1
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.15 * t + 30 for s, t in target.items())
    assert sum(taken.values()) == pytest.approx(sum(own.values()), rel=0.03)
    assert plain(rows) == plain(mix(documents).collect())
    # The rates tilt exponentially in the size: log rates of a source are proportional to it.
    tilts = defaultdict(set)
    for r in rows:
        if r["size"] and r["rate"] < 3:
            tilts[r["source"]].add(round(np.log(r["rate"]) / r["size"], 9))
    assert all(len(x) == 1 for x in tilts.values())


def test_mix_of_odd_texts(spark, odd, empty):
    rows = mix(odd).collect()
    own, target = brute_targets([(r["source"], len(words(r["text"]))) for r in odd.collect()])
    assert len(rows) == odd.count() and mix(empty).count() == 0
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"]) for r in rows)
    copies = mixed_documents(odd)
    assert copies.columns == odd.columns
    assert sum(len(words(r["text"])) for r in copies.collect()) == sum(r["taken"] for r in rows)
    hot = spark.createDataFrame([(1, "a b c", "s")] * 200 + [(2, "a b", "t")] * 3, "doc_id long, text string, source string")
    made = mix(hot, settings=MixSettings(bucket=16)).collect()
    assert len(made) == 203 and max(r["copies"] for r in made) <= 3


def test_tokens_are_the_tokenizers():
    encoder = Encoder(default_tokenizer())
    texts = ["", " a", "it's I'LL 'tis", "İ Σ ŉ", "á <|endoftext|> <|", "x²³ 12 ½ ª µ ß ſ", "tab\tnl\n\x1c\x85 end", "日本", None, "###abc'd%% abc abc"]
    for text, ids in zip(texts, encoder.ids_of(pa.array(texts))):
        assert ids.tobytes() == encoder.whole(text or "")


def test_words_begin_where_the_tokenizer_cuts():
    rng = np.random.default_rng(8)
    parts = ["'", "'", "s", "t", "re", "ve", "m", "ll", "d", "'S", "1", "²", "½", "é", "ÿ", "Ÿ", "ª", "µ", "×", "¿", "<", "/w>", "abc", "-", ".", " ", "\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60)).tolist()) for _ in range(3000)] + ["", " ", "'", "x'l", "x'", "'r e", "'r", "''s's't'", None]
    encoder, one = Encoder(default_tokenizer()), Encoder(default_tokenizer())
    for text, ids in zip(texts, encoder.ids_of(pa.array(texts))):
        assert ids.tobytes() == encoder.whole(text or ""), text
    for text in texts[-400:]:  # a text is a batch of its own
        assert one.ids_of(pa.array([text], pa.string()))[0].tobytes() == encoder.whole(text or ""), text
    assert one.ids_of(pa.array([None, None], pa.string()))[0].size == 0 and one.ids_of(pa.array([], pa.string())) == []


def test_only_distinct_words_are_kept_and_encoded(monkeypatch):
    class Counting:
        def __init__(self, inner):
            self.inner, self.seen = inner, []

        def encode_batch_fast(self, texts, **how):
            self.seen += [word for text in texts for word in text.split()]
            return self.inner.encode_batch_fast(texts, **how)

    names = ["".join(letters) for letters in itertools.product("abcde", repeat=4)]
    ends = ["", ".", ",", "!!", "'s", "-x"]
    texts = [" ".join(f"{name}{end}" for name in names[i::25]) for end in ends for i in range(25)]
    encoder = Encoder(default_tokenizer())
    encoder.of_words = Counting(encoder.of_words)
    for low in range(0, len(texts), 20):
        encoder.ids_of(pa.array(texts[low : low + 20]))
    distinct = {*names, ".", ",", "!!", "'s", "-", "x"}
    assert sorted(encoder.of_words.seen) == sorted(distinct) == sorted(encoder.words)  # not the 3,750 runs they stand in
    monkeypatch.setattr(token_ids, "_MOST_WORDS", 100)  # words are forgotten all the time
    for low in range(0, len(texts), 7):
        part = texts[low : low + 7]
        for text, ids in zip(part, encoder.ids_of(pa.array(part))):
            assert ids.tobytes() == encoder.whole(text)
        assert len(encoder.words) <= 100 + 7 * 25 + 6
    assert len(encoder.pool) == encoder.size.sum() and len(encoder.words) == len(encoder.size) == len(encoder.met)


def test_another_tokenizer_gets_whole_texts():
    path = default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    other, texts = Encoder(path), ["", "Hello  World", "it's\tI'LL", None, "á 日本 <|endoftext|>"]
    assert Encoder(default_tokenizer()).by_words and not other.by_words
    for text, ids in zip(texts, other.ids_of(pa.array(texts))):
        assert ids.tolist() == Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def best_fit(lengths, capacity=4096):
    """Free room of the sequences when every piece, from long to short, goes where it fits best."""
    free = []
    for size in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(free, size)
        left = (free.pop(at) if at < len(free) else capacity) - size
        bisect.insort(free, left)
    return free


def test_packing_never_needs_more_than_best_fit():
    rng = np.random.default_rng(5)
    lognormal = np.minimum(4095, rng.lognormal(6.6, 1.1, 6000).astype(int) + 1)
    middle, clustered = rng.integers(500, 1900, 6000), rng.integers(1300, 1500, 6000)
    two = np.r_[rng.integers(1200, 1300, 3000), rng.integers(2600, 2900, 3000)]
    needs = []
    for lengths in (rng.integers(1, 4096, 6000), lognormal, middle, clustered, two, rng.integers(2000, 4096, 3000), np.full(50, 4095), np.array([7])):
        sequence, _ = pack_lengths(lengths, PackSettings())
        assert np.bincount(sequence, lengths).max() <= 4096
        needs.append((len(set(sequence.tolist())), len(best_fit(lengths))))
    assert all(scheme <= plain for scheme, plain in needs)
    assert all(needs[i][0] < 0.99 * needs[i][1] for i in (2, 3))  # the configurations of the scheme pay here


def test_packing(odd, empty, documents):
    encoder = Encoder(default_tokenizer())
    for docs, s in ((odd, PackSettings(shard_pieces=4)), (documents, PackSettings(capacity=256, shard_pieces=500))):
        found = best_fit_packing(docs, settings=s).toPandas()
        want = []
        for r in docs.collect():
            ids = np.frombuffer(encoder.whole(r["text"] or "") + np.array([1], "<u4").tobytes(), "<u4")
            want += [(r["doc_id"], k, a, len(ids[a : a + s.capacity]), zlib.crc32(ids[a : a + s.capacity].tobytes())) for k, a in enumerate(range(0, len(ids), s.capacity))]
        none = found["doc_id"].isna()
        got = [(None if n else int(d), *x) for n, d, *x in zip(none, found["doc_id"], found["piece"], found["start"], found["length"], found["ids_crc32"])]
        assert plain(got) == plain(want)
        placed = found.sort_values(["sequence_id", "offset"])
        held = placed.groupby("sequence_id")
        assert (held["length"].cumsum() - placed["length"] == placed["offset"]).all()
        assert held["length"].sum().max() <= s.capacity
    assert found["sequence_id"].nunique() <= 1.03 * found["length"].sum() / 256 + 2
    assert best_fit_packing(empty).count() == 0
    kept = best_fit_packing(documents.limit(3), with_ids=True).first()
    assert zlib.crc32(np.array(kept["ids"], "<u4").tobytes()) == kept["ids_crc32"]


def test_configurations_cover_the_need():
    sizes, need = np.array([130, 90, 60, 40]), np.array([100.0, 80, 120, 200])
    columns, use = configurations(sizes, need, 256)
    assert (columns @ use >= need - 1e-6).all() and (sizes @ columns <= 256).all()
    assert use.sum() <= 1.05 * (sizes @ need) / 256 + 15
    lengths = np.random.default_rng(3).integers(1, 4096, 3000)
    sequence, offset = pack_lengths(lengths, PackSettings(groups=64))
    sums = np.bincount(sequence, lengths)
    # Half of these pieces are longer than half a sequence, so each of them needs one of its own.
    assert sums.max() <= 4096 and len(sums) <= 1.04 * max(lengths.sum() / 4096, (lengths > 2048).sum()) + 2
    many = np.minimum(4095, np.random.default_rng(1).lognormal(6.6, 1.1, 16_384).astype(int) + 1)
    assert len(set(pack_lengths(many, PackSettings())[0].tolist())) <= 1.005 * many.sum() / 4096 + 1
