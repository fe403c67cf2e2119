import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from specloom.llm import prefix_trie as pt
from specloom.llm.common import settle
from tests.oracle import same

from .util import WORD

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c % 20 if c >= 0 else -(-c % 20)
        out[c] = convs.get(c - rest, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for k, ids in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = [x for x in below if not any(y[:-1] == x and y for y in members)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(ids), len(k), min(members[k[:-1]]) if k else None, len(ids), sum(len(x) == len(k) + 1 for x in below), len(leaf), saved, digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]) for r in df.collect()), key=str)


def test_query_equals_sql(spark, sf_dir):
    same(pt.op11_prefix_trie(spark, sf_dir), pt.ORACLE, sf_dir)


def random_rows(rng, convs, turns=6):
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", ""])) for c in range(convs) for t in range(rng.randrange(turns))]
    return rows + [(c, t, "user", "the same start") for c in range(convs, convs + 30) for t in range(4)] + [(convs + 50, t, "user", f"long {t // 2}") for t in range(300)] + [(convs + 51, t, "user", f"long {t // 2}") for t in range(290)]


@pytest.mark.parametrize("shards,per_shard", [(1, 8), (5, 2), (40, 9), (97, 1)])
def test_trie_by_shards(spark, shards, per_shard):
    rows = random_rows(random.Random(shards), 60)
    random.Random(1).shuffle(rows)
    paths = settle(pt.plain_paths(spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash"))), "paths")
    assert got(pt.trie(paths, shards, per_shard)) == brute(sequences(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = random_rows(rng, 90) + [(-7, 0, "user", "x"), (-7, 1, "user", "y"), (10**12 + 3, 0, "user", "far")]
    rows += [(None, 0, "user", "nobody"), (100, None, None, None), (100, 0, "b", "tie"), (100, 0, "a", "tie"), (100, 0, "a", "tie"), (101, None, "", ""), (101, 2, "u", "w " * 20_000)]
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(pt.op11_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(sequences(rows)))


def test_no_conversations(spark):
    paths = settle(pt.plain_paths(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)), "paths")
    assert pt.trie(paths).collect() == []
