"""Chat formatting, conversation trie and resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.llm import chat, resample, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, part int, node string"
ODD = [(1, 0, "user", "hi", 0, "x"), (1, 1, "assistant", "</s>[INST] ok [/INST]", 0, "x"), (1, None, "system", None, 0, "x"),
       (2, 0, "assistant", "", 0, None), (2, 1, "assistant", "a\u2060b\u2060\u2060[\u2060INST] é日本 <|endoftext|>", 0, None), (2, 1, "assistant", "a", 0, None),
       (2, 1, "assistant", "a", 0, None), (3, 5, None, "x\n[INST][/INST", 0, None), (None, 0, "user", "[[INST]]", 0, None),
       (7, 0, "[INST]\n", "word " * 30000, 0, None), (7, 1, "assistant", "endé " * 4000, 0, None)]


def _sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _by_conv(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def _digests(rows):
    return {(c, len(v), _sha(f"{r}\n{x}\n" for r, x in v), sum(len(x) for r, x in v if r == "assistant"), _sha(x for r, x in v if r == "assistant"))
            for c, v in _by_conv(rows).items()}


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 20])
def test_chat_round_trip(spark, part_chars):
    df = spark.createDataFrame(ODD, SCHEMA)
    formatted = chat.format_conversations(df, part_chars=part_chars)
    back = chat.read_back(formatted).collect()
    assert {tuple(r)[:5] for r in back} == _digests(ODD)
    rows = formatted.collect()
    assert {r["conv_id"]: r["formatted_chars"] for r in back} == {
        c: sum(len(r["text"]) for r in rows if r["conv_id"] == c) for c in {r["conv_id"] for r in rows}}
    whole = chat.format_conversations(df).collect()
    ids = lambda found, c: [i for r in sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["part"]) for i in r["ids"]]
    assert all(ids(rows, c) == ids(whole, c) for c in (1, 2, 3, 7, None))
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_query_and_tokens(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = [tuple(r) for r in t] + chat.PROBE
    assert {tuple(r)[:5] for r in chat.op11_chat(spark, SF).collect()} == _digests(rows)
    one = [r for r in chat.format_conversations(spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string")).collect()][0]
    special = [i for i in one["ids"] if i >= 50257]
    assert special == [50257, 50258, 50259] * 2  # each control string is one token, those in texts are none
    assert one["starts"][0] == 0 and one["stops"][-1] == len(one["text"])


def test_templates_that_cannot_be_undone():
    for bad in (dict(open="["), dict(open="ab", close="bc"), dict(escape="<"), dict(open="</s>")):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    t = chat.Template(open="aab", header_end="cdd", close="efg", reserved=(), escape="!")
    special, runs, turn = t.compiled()
    for x in ("aab", "aaab", "a!ab!!", "!aab!cdd", "efgefg!", "", "!!!"):
        y = t.escaped(x, special)
        assert t.unescaped(y, runs) == x and not turn.search(y) and not any(m in y for m in ("aab", "cdd", "efg"))


def test_mask_by_binary_search():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        edge = np.sort(rnd.choice(200, 20, replace=False)).reshape(-1, 2)
        cut = np.concatenate([[0], np.sort(rnd.choice(np.arange(1, 200), 60, replace=False)), [200]])
        got = chat.loss_mask(cut[:-1], cut[1:], edge)
        assert list(got) == [any(a < q and b > p for p, q in edge) for a, b in zip(cut[:-1], cut[1:])]
    assert not chat.loss_mask(np.array([0]), np.array([5]), np.zeros((0, 2))).any()


def _brute_trie(paths):
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in cs if len(paths[c]) == len(node))
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved,
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def _rebuilt(rows):
    own = _by_conv([r for r in rows if r[0] is not None])
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_trie_against_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rnd = np.random.default_rng(3)
    odd = [(300 + i, t, "user", "ab"[rnd.integers(2)] * (t + 1), 0, "x") for i in range(150) for t in range(rnd.integers(1, 9))]
    odd += [(c, t, r, x, 0, "x") for c in (401, 402, 560) for t, r, x in ((None, None, None), (0, "user", ""))]
    odd += [(None, 0, "user", "a", 0, "x"), (801, 0, "user", "word " * 40000, 0, "x"), *[(900 + i, 0, "user", "only", 0, "x") for i in range(99)]]
    for name, table in (("a", [(*r, 0, "x") for r in rows]), ("b", odd), ("c", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(table, SCHEMA).write.parquet(f"{d}/conversations.parquet")
        found = trie.op12_trie(spark, d)
        assert {tuple(r) for r in found.collect()} == _brute_trie(_rebuilt(table)), name
    # shards of any size meet in the same nodes
    paths = trie.turn_paths(spark.createDataFrame(odd, SCHEMA))
    small = trie.trie(paths, shard_convs=3).collect()
    assert len(small) == len({(r["conv_id"], r["depth"]) for r in small})
    assert sorted(map(str, small)) == sorted(map(str, trie.trie(paths).collect()))


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute_draw(docs, target):
    def feats(text):
        w = _words(text)
        return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    rows = []
    for i, x in docs:
        f = feats(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in rows)


def test_resample_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted(str(tuple(r)) for r in resample.op13_resample(spark, SF).collect()) == _brute_draw(docs, target)
    long = "É" * 70 + " b " + "c" * 65 + " " + "d" * 200 + " Ü x-y_z " * 30
    odd = [(5, long), (5, long), (None, long), (6, None), (7, ""), (8, "!!"), (-9, "one Two three " * 9000), (1 << 40, long + " x"),
           *[(100 + i % 70, docs[0][1]) for i in range(90)]]
    df = spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, rank int")
    for table, goal in ((df, target), (df, []), (df.where("false"), target)):
        out = resample.resample(table, spark.createDataFrame([(x,) for x in goal], "text string")).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(str(tuple(r)) for r in out.collect()) == (_brute_draw(odd, goal) if table is df else [])


def test_radix_places_against_sort(spark):
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(-(1 << 62), 1 << 62, 3000), rnd.integers(0, 5, 3000)
    rows = [(int(b[i]), int(a[i % 1000])) for i in range(3000)]
    df = spark.createDataFrame(rows, "b long, a long").repartition(5)
    found = resample.radix_places(df, ["b", "a"], blocks=7).orderBy("_pos").collect()
    assert [r["_pos"] for r in found] == list(range(3000))
    assert [(r["b"], r["a"]) for r in found] == sorted(rows, key=lambda r: (r[0], r[1] % (1 << 64)))
    same = resample.radix_places(df.withColumn("a", F.lit(1)).withColumn("b", F.lit(2)), ["b", "a"], block_rows=100)
    assert sorted(r["_pos"] for r in same.collect()) == list(range(3000))
