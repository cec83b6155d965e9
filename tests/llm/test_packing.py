import random
from collections import defaultdict

from graphloom.llm.packing import fill_report, pack, token_counts

TIERS = (16, 64, 256)


def packed(spark, lengths, tiers=TIERS, step=4):
    df = spark.createDataFrame([(i, n, 0) for i, n in lengths], "doc_id long, n_tokens long, row long").repartition(4)
    return pack(df, tiers, step)


def check(rows, lengths, tiers=TIERS):
    largest = max(tiers)
    pieces, containers = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.tokens))
        if r.container_id is not None:
            containers[r.container_id, r.capacity].append((r.position, r.tokens))
    total = defaultdict(int)
    for i, n in lengths:
        total[i] += n
    assert {i: sum(t for _, t in p) for i, p in pieces.items()} == dict(total)
    for i, n in lengths:
        if n <= largest:
            assert (0, n) in pieces[i]
    assert len({c for c, _ in containers}) == len(containers)
    for (_, capacity), content in containers.items():
        assert capacity in tiers
        end = 0
        for position, tokens in sorted(content):
            assert position == end
            end += tokens
        assert end <= capacity
    return containers


def test_valid_and_full(spark):
    random.seed(7)
    lengths = [(i, random.choice([random.randint(1, 16), random.randint(1, 16), random.randint(17, 64), random.randint(65, 256)])) for i in range(3000)] + [(5000 + i, 8) for i in range(1500)] + [(9000, 1000), (9001, 512), (9002, 257)]
    rows = packed(spark, lengths).collect()
    containers = check(rows, lengths)
    space = sum(c for _, c in containers)
    assert sum(n for _, n in lengths) / space > 0.99


def test_edges(spark):
    for lengths in ([], [(1, 0)], [(1, 256)], [(1, 257), (2, 0), (None, 3), (None, 3)], [(1, 1)]):
        rows = packed(spark, lengths).collect()
        check(rows, lengths)
        assert {r.doc_id for r in rows if r.container_id is None} == {i for i, n in lengths if n == 0}


def test_step_groups_are_even(spark):
    random.seed(8)
    lengths = [(i, random.randint(1, 256)) for i in range(4000)]
    df = packed(spark, lengths, step=8)
    sums = defaultdict(lambda: defaultdict(int))
    for r in df.collect():
        sums[r.capacity][r.step_group] += r.tokens
    for groups in sums.values():
        if len(groups) > 3:
            assert max(groups.values()) / min(groups.values()) < 1.35
    report = {r.capacity: r for r in fill_report(df).collect()}
    assert sum(r.tokens for r in report.values()) == sum(n for _, n in lengths)
    assert all(r.fill <= 1 for r in report.values())


def test_token_counts_are_those_of_the_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello world, 123!", "", None, "né 中文 \U0001f600", "a" * 5000, "<|endoftext|> x", "  \n\n tabs\t"]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
