"""The pipeline, stage by stage, on the smallest table."""

import itertools
import re
import string

import pytest

import corpus_pipeline
from paperloom.llm import language as language_module
from paperloom.llm import pieces, simhash
from paperloom.llm.common import as_table
from test_models import agenda, plain_targets

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_lines(rows):
    """Texts without lines that ten sources share, but for the document with the smallest id that has them."""
    normal = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))
    sites, owner = {}, {}
    for r in rows:
        for line in {normal(x) for x in (r["text"] or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(r["source"])
            owner[line] = min(owner.get(line, r["doc_id"]), r["doc_id"])
    gone = lambda r, line: len(sites.get(normal(line), ())) >= 10 and owner[normal(line)] != r["doc_id"]
    return {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not gone(r, x)) for r in rows}


def plain_mix(rows):
    """Words that each source's copies should have: its target, met as well as whole passes and the lengths of its texts allow."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    own = {}
    for r in rows:
        own.setdefault(r["source"], []).append(r["doc_id"])
    sizes = {s: sum(size[i] for i in ids) for s, ids in own.items()}
    out = {}
    for s, aim in plain_targets(sizes).items():
        reach, passes = 1, int(aim // sizes[s])
        for i in own[s]:
            reach |= reach << size[i]
        rest = round(aim - passes * sizes[s])
        out[s] = passes * sizes[s] + max(x for x in range(rest + 1) if reach >> x & 1)
    return out, size


def test_stages(spark, sf_dir):
    """Each stage against a plain version of it, on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    net = language_module.fit(docs)
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = as_table(stage(spark, docs, sf_dir), name)
        kept.append(docs.collect())
        assert docs.columns[: len(columns)] == columns
    first, language, lines, near, mixed, encoded = kept
    read = dict(zip((r["doc_id"] for r in first), language_module.Reader(net).read([r["text"] for r in first]), strict=True))
    assert {r["doc_id"] for r in language} == {i for i, (lang, score) in read.items() if lang != "und" and score >= corpus_pipeline.MIN_SCORE} and len(language) >= 0.99 * len(first)
    assert {r["doc_id"]: r["text"] for r in lines} == plain_lines(language) and all(r["n_chars"] == len(r["text"]) for r in lines)
    shingles = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in lines}
    fps = {r["doc_id"]: simhash.fingerprint(r["text"], 5) for r in lines}
    up = {i: i for i in shingles}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(shingles), 2):
        x, y = shingles[a], shingles[b]
        if x == y or (fps[a] ^ fps[b]).bit_count() <= 2 or len(x & y) >= 0.8 * len(x | y):
            up[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["doc_id"] for r in near} == {i for i in up if find(i) == i}
    aims, size = plain_mix(near)
    words = dict.fromkeys(aims, 0)
    for r in mixed:
        words[r["source"]] += size[r["doc_id"]]
    assert words == aims and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    p = pieces.model(pieces.MODEL)
    assert len(encoded) == len(mixed) and all(r["lossless"] for r in encoded)
    for r in encoded[:40]:
        assert list(r["token_ids"]) == agenda(p, r["text"], pieces.document_key(r["doc_id"], pieces.SEED), pieces.DROPOUT)
        assert b"".join(p.out[i] for i in r["token_ids"]).decode()[1:] == r["text"]


@pytest.mark.parametrize("empty", [False, True])
def test_cases(spark, empty):
    """Nulls, repeated rows, long and empty texts, and columns with the operators' own names."""
    text = "the quick brown fox jumps over the lazy dog. " * 3
    rows = [(i, f"{text}\nline {i} of many words here", "en", f"s{i % 3}") for i in range(20)] + [(20 + i, f"der schnelle braune fuchs springt {i}\nviele worte", "de", None) for i in range(20)]
    rows += [(None, text, None, "s1"), (50, None, "en", "s1"), (51, "", None, None), (52, "123 456", "en", "s1"), (0, rows[0][1], "en", "s0"), (53, "fox " * 100_000, "en", "s2")]
    extra = "score string, lang_pred int, removed_lines string, key int, id int, fp int, size int, copies int, bands int, __x int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "own", 1, "r", 2, 3, 4, 5, 6, 7, 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs = docs.limit(0) if empty else docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = as_table(stage(spark, docs, "unused"), name)
        out = docs.collect()
        assert docs.columns[: len(columns)] == columns
        assert all((r["score"], r["lang_pred"], r["removed_lines"], r["key"], r["__x"]) == ("own", 1, "r", 2, 8) for r in out)
        ids = [r["doc_id"] for r in out]
        if name == "language_id" and not empty:
            assert len(ids) == len(rows) - 3 and not {50, 51, 52} & set(ids)
        if name == "near_duplicates" and not empty:
            assert ids.count(0) == 1 and 53 in ids
    assert bool(out) != empty and all(r["lossless"] for r in out)


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, "").count() == 2
