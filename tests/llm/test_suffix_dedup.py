"""Heavy grams of the byte-string dedup."""

import numpy as np
import pytest
from brute import sha, string_dedup

from strata.llm.blocks import Blocks, unbundle, unpack
from strata.llm.suffix_dedup import Counts, _Suffixes, drop_repeated_strings, find_grams

LINE = "This line of ninety bytes stands in every document of the corpus, as licence lines will do."[:90]


def line_of(size):
    """Bytes that don't repeat within themselves."""
    return (LINE + "".join(map(chr, np.random.default_rng(0).integers(97, 123, max(size - 90, 0)))))[:size]


def shared_line(n, seed=1, size=90):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    return [(i, text(150) + line_of(size) + text(150)) for i in range(n)]


@pytest.mark.parametrize("size", [90, 98, 150, 400, 2000])
def test_a_line_of_all_documents_is_no_hot_range(spark, size):
    """Windows inside the line travel once a block; of those that reach out of it only such as share two or three outer letters by chance (light grams), and no key crowds one range."""
    docs = spark.createDataFrame(shared_line(4000, size=size), "doc_id long, text string")
    blocks = Blocks(docs, "doc_id", "text", "suffix_dedup")
    counts = Counts(64, 64, 64)
    find_grams(blocks, 100, counts)
    sent = blocks.messages(lambda block: _Suffixes(block, 100, counts).contexts()).select("payload").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpack(m)[0] for m in unbundle([bytes(r.payload) for r in sent])[1])])
    many = blocks.table.count()
    assert len(keys) <= many * max(size - 99, 0) + 3 * 4000
    assert max(np.unique(keys, return_counts=True)[1]) <= 64


def test_split_grams_remove_the_same(spark):
    rows = shared_line(150)
    rows += [(200 + i, t) for i, t in shared_line(30, seed=2)] + [(300 + i, t[:250] + "!" + t[251:]) for i, t in shared_line(60, seed=2)] + [(400, LINE * 3), (401, "x" + LINE * 2), (402, None)]
    rows += [(500 + i, t) for i, t in shared_line(40, seed=3, size=98)] + [(600 + i, t) for i, t in shared_line(40, seed=4, size=250)] + [(700 + i, t[:200] + "?" + t[201:]) for i, t in shared_line(20, seed=4, size=250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = string_dedup(rows, 100)
    for heavy in (2, 8, 64):
        found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_from), sha(bytes(r.kept))) for r in drop_repeated_strings(docs, heavy=heavy).collect()}
        assert found == want
