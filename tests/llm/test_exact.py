import hashlib
import re
from collections import Counter, defaultdict

import pytest

from bindery.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append((r[0] is None, r[0] if r[0] is not None else 0, k))
    out = Counter()
    for text, members in groups.items():
        low = min(members)
        for m in members:
            out[(rows[m[2]][0], rows[low[2]][0], len(members), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out, len(groups)


@pytest.mark.parametrize("kind", ["docs", "stored"])
@pytest.mark.parametrize("bits", [256, 4])
def test_groups(request, strange_rows, kind, bits):
    """With four bits nearly all digests collide, and the check on full bytes keeps texts apart."""
    found = exact.exact_groups(request.getfixturevalue(kind), digest_bits=bits).collect()
    expected, groups = brute(strange_rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == groups


def test_state_holds_over_batches(docs, strange_rows):
    found = exact.exact_groups(docs.repartition(6), max_bytes_per_trigger=None, max_files_per_trigger=1).collect()
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute(strange_rows)[0]


@pytest.mark.parametrize("bits", [256, 4])
def test_a_second_call_meets_the_first_ones_digests(spark, tmp_path, bits):
    """Copies of an earlier call's rows are dropped; with four bits, texts that merely collide with them stay."""
    top, parts = f"file://{tmp_path}", ([(k, f"text {k}") for k in range(20)], [(100 + k, f"text  {k}") for k in range(10, 40)] + [(5, "text 15"), (200, None)], [(300, " text"), (301, "text 39"), (302, "")])
    kept, sizes = [], {}
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{top}/docs-{k}")
        for r in exact.exact_groups(spark.read.parquet(f"{top}/docs-{k}"), digest_bits=bits, state_dir=f"{top}/state").collect():
            kept += [r["id"]] * r["kept"]
            sizes[r["id"]] = r["group_size"]
    if bits == 256:  # a later row of smaller id is kept too
        assert sorted(kept) == sorted([*range(20), *range(120, 140), 5, 200, 300])
        assert sizes[110] == 2 and sizes[115] == 3 and sizes[302] == 2 and sizes[301] == 2 and sizes[130] == 1
    else:
        assert set(range(20)) <= set(kept) and 110 not in kept


def test_deduplicated(docs, strange_rows):
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == brute(strange_rows)[1]


def test_empty(empty):
    assert exact.exact_groups(empty).count() == 0
