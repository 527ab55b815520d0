"""Sharding and packing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import packing, sharding
from tests.llm.helpers import collected, docs, text


@pytest.fixture(scope="module")
def many(spark):
    return docs(spark, [(i, text(i, 5)) for i in range(3000)] + [(None, None), (7, text(7, 5)), (7, text(7, 5)), (5000, "")])


def test_shards_obey_the_key_law(spark, many):
    rows = sharding.shard_documents(many.withColumn("shard", F.lit("clash"))).collect()
    assert len(rows) == 3004
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 100 < len(slots) < 300
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {16}
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    null = next(r for r in rows if r["doc_id"] is None)
    assert null["size"] == 1 and null["text_crc32"] == 0
    one = next(r for r in rows if r["doc_id"] == 3)
    assert one["size"] == len(text(3, 5)) + 1 and one["text_crc32"] == zlib.crc32(text(3, 5).encode())


def test_weights_move_rows_only_in_their_subtree(spark, many):
    keyed = many.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.monotonically_increasing_id().alias("n"))
    tree = sharding.standard_tree(16)
    heavier = [sharding.Leaf(leaf.region, leaf.rack, leaf.shard, 3.0 if leaf.shard == 2 else 1.0) for leaf in tree]
    before = {r["n"]: r for r in sharding.descend(keyed, "key", tree).collect()}
    after = {r["n"]: r for r in sharding.descend(keyed, "key", heavier).collect()}
    moved = [n for n in before if before[n]["shard"] != after[n]["shard"]]
    assert moved
    for n in moved:  # into the region, the rack or the shard that became heavier
        a, b = before[n], after[n]
        assert (b["region"] == 0 and a["region"] != 0) or (b["rack"] == 0 and a["rack"] != 0) or b["shard"] == 2
    assert sum(r["shard"] == 2 for r in after.values()) > 2 * sum(r["shard"] == 2 for r in before.values())


def test_no_documents_no_shards(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def restored(rows, sources):
    """Every id of every document lies in one piece, and sequences are gapless."""
    assert sum(r["length"] for r in rows) == sum(len(s) for s in sources)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    return [sum(r["length"] for r in p) for p in sequences.values()]


def test_packing_is_a_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    given = [(i, text(i, int(rng.integers(1, 900)))) for i in range(120)] + [(200, None), (201, ""), (202, "a<|endoftext|>b  é\n\n x"), (203, "x" * 50_000), (3, text(3, 4))]
    rows = packing.pack(docs(spark, given).withColumn("start", F.lit(1)).coalesce(2)).collect()
    ids = {}
    for i, t in given:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    fills = restored(rows, [x for group in ids.values() for x in group])
    assert sum(f == 1024 or (f & (f - 1)) == 0 for f in fills) >= len(fills) - 2
    for r in rows:
        if r["doc_id"] == 3:
            continue
        own = np.array(ids[r["doc_id"]][0], "<u4")
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == sum(map(len, ids[3]))
    assert next(r["doc_tokens"] for r in rows if r["doc_id"] == 200) == 1


def test_step_groups_hold_equal_places():
    packer = packing.Packer(0)
    rng = np.random.default_rng(2)
    for a in range(0, 400, 50):
        packer.add(list(range(a, a + 50)), [np.arange(n, dtype="<u4") for n in rng.integers(1, 1500, 50)])
    packer.finish()
    tiers = {(r[8], r[5]): r[7] for r in packer.rows}
    sums = {}
    for (group, _), tier in tiers.items():
        sums[group] = sums.get(group, 0) + tier
    assert all(s <= 8192 for s in sums.values()) and sum(s == 8192 for s in sums.values()) >= len(sums) - 2


def test_no_documents_no_pieces(spark):
    assert collected(packing.pack(docs(spark, []))) == []
