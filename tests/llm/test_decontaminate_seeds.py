"""Every overlap that the verification accepts is found by a seed."""

from itertools import combinations

from quirelake.llm import decontaminate

MASKS, LEAST, PENALTY = decontaminate.MASKS, decontaminate.LEAST, decontaminate.PENALTY


def best(pattern):
    here = top = 0
    for same in pattern:
        here = max(0, here + (1 if same else -PENALTY))
        top = max(top, here)
    return top


def test_no_stretch_without_a_seed():
    """Over stretches of any length: states are the sum so far and the last words, until a mask seeds."""
    span = max(map(len, MASKS))
    todo, seen = [(0, ())], set()
    while todo:
        total, tail = todo.pop()
        for same in (True, False):
            here = total + (1 if same else -PENALTY)
            last = (*tail, same)[-span:]
            if here <= 0 or any(len(last) >= len(m) and all(x or bit == "0" for x, bit in zip(last[-len(m) :], m, strict=True)) for m in MASKS):
                continue
            assert here < LEAST, last
            if (here, last) not in seen:
                seen.add((here, last))
                todo.append((here, last))


def test_substitution_patterns(spark):
    items = [(n, [f"w{n}x{i}" for i in range(n)]) for n in (1, 3, 7, 8, 9, 10, 12, 15, 16, 20)]
    rows, expected = [], {}
    for n, words in items:
        for k in range(5 if n < 20 else 4):
            for off in combinations(range(n), k):
                doc = len(rows)
                rows.append((doc, " ".join(["before", *("other" if i in off else w for i, w in enumerate(words)), "after"])))
                expected[doc] = best([i not in off for i in range(n)]) < min(LEAST, n)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in items] + [(99, ""), (98, None)], "item_id long, text string")
    assert {r.doc_id: r.kept for r in decontaminate.decontaminate(table, bench).collect()} == expected
