import random

from corpusloom.llm import packing


def plain_pack(sizes, lengths, per_bin):
    """Best fit decreasing by linear search."""
    room, opened, place = [], [], {}
    left = sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            best = min((x for x in lengths if x >= sizes[i]), key=lambda x: ((x + x * x / packing.ATTENTION + per_bin) / min(x, left), x))
            b = len(room)
            room.append(best)
            opened.append(best)
        place[i] = (b, opened[b] - room[b])
        room[b] -= sizes[i]
        left -= sizes[i]
    used = [o - r for o, r in zip(opened, room, strict=True)]
    return [place[i] for i in range(len(sizes))], [min(x for x in lengths if x >= u) for u in used]


def test_pack_equals_plain_version():
    r = random.Random(3)
    for _ in range(60):
        lengths = tuple(sorted(r.sample([8, 16, 32, 64, 128], r.randint(1, 4))))
        sizes = [r.randint(1, lengths[-1]) for _ in range(r.randint(0, 60))]
        assert packing.pack(sizes, lengths, 4) == plain_pack(sizes, lengths, 4)


def test_bins_shrink():
    assert packing.pack([5], (8, 64), 64) == ([(0, 0)], [8])


def test_several_lengths_beat_each_alone():
    """Total cost of the bins as they are in the end, against the same packing with the longest length only."""
    r = random.Random(5)
    for mu in (4.5, 5.5, 6.5, 7.5):
        sizes = [min(8192, max(1, int(r.lognormvariate(mu, 1.2)))) for _ in range(4000)]
        total = lambda lengths: sum(packing.cost(x) for x in packing.pack(sizes, lengths)[1])  # noqa: B023, E731
        assert total(packing.LENGTHS) < total((8192,))
        _, opened = packing.pack(sizes, packing.LENGTHS)
        # What is opened: each length but for what shrinks in the end.
        assert len(set(opened)) >= 3
        # Any length that holds all sizes, alone.
        longest = max(sizes)
        assert all(total(packing.LENGTHS) < total((x,)) for x in packing.LENGTHS if x >= longest)


def test_repeated_rows_spread(spark):
    df = spark.range(3000).selectExpr("7L as doc_id", "'a b c' as text")
    got = packing.pack_documents(df, (4, 8), 1, group_docs=300).collect()
    groups = {x.bin_id.split("-")[0] for x in got}
    assert len(got) == 3000 and len(groups) == 10


def check(rows, sizes, lengths):
    bins, by_doc = {}, {}
    for r in rows:
        if r.bin_id is None:
            assert r.piece_tokens == 0
            continue
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_tokens, r.bin_length, r.bin_tokens))
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.piece_tokens
    assert by_doc == {k: v for k, v in sizes.items() if v}
    for pieces in bins.values():
        pieces.sort()
        at = 0
        for offset, n, length, used in pieces:
            assert offset == at and used == sum(p[1] for p in pieces) <= length
            assert length == min(x for x in lengths if x >= used)
            at += n


def test_documents(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 90)), i) for i in range(300)] + [(900, None, 1), (901, " \n", 1), (902, "w " * 1000, 1), (None, "a b", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, bin_id long"), (16, 32, 64), 4, 50).collect()
    sizes = {}
    for i, t, _ in rows:
        sizes[i] = sizes.get(i, 0) + len((t or "").split())
    check(got, sizes, (16, 32, 64))
    assert sum(r.doc_id == 902 for r in got) == 16


def test_repeats_and_empty(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "a b c")] * 4, "doc_id long, text string"), (4, 8), 1).collect()
    check(got, {1: 12}, (4, 8))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack_documents(docs).collect()
    check(got, {r.doc_id: len(r.text.split()) for r in docs.collect()}, packing.LENGTHS)
