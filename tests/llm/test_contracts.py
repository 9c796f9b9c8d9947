"""Every registered query of the corpus operators over the whole of a small table: names and kinds of columns, and the rows themselves."""

import os
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import regex

import __spark_entry__ as entry
from seamline.llm import pii
from seamline.llm.queries import OPEN_KEY
from tests.llm.test_mixing import targets
from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_simhash import components, plain as plain_fingerprint
from tests.llm.test_whiten import check as check_whitened

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data absent")
COLUMNS = {
    "op1_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_repetition": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_pii": "doc_id bigint, text string, n_replaced int",
    "op5_lines": "doc_id bigint, text string, n_lines int, n_removed int",
    "op6_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_whiten": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op13_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}
_read = {}


@pytest.fixture(scope="module")
def got(spark):
    """The rows of a query, read once."""

    def of(name):
        if name not in _read:
            _read[name] = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
        return _read[name]

    yield of
    _read.clear()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len({r["doc_id"] for r in t}) == len(t)
    return {r["doc_id"]: r for r in t}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    kinds = dict(entry.queries()[name](spark, SF).dtypes)
    for c, kind in (x.split() for x in COLUMNS[name].split(", ")):
        assert kinds.get(c) == kind, c


def test_one_row_a_document(got, docs):
    for name in ("op2_repetition", "op4_pii", "op5_lines", "op6_mix", "op7_quality", "op8_substring", "op10_simhash", "op12_toxicity"):
        assert Counter(r["doc_id"] for r in got(name)) == Counter(list(docs)), name


def test_repetition(got, docs):
    for r in got("op2_repetition"):
        text = docs[r["doc_id"]]["text"] or ""
        w, seen, covered, dup = words(text), defaultdict(list), set(), 0
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        for at in seen.values():
            if len(at) > 1:
                covered.update(k for i in at for k in range(i, i + 8))
        lines = set()
        for line in text.split("\n"):
            dup += bool(words(line)) and line in lines
            lines.add(line)
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
        if not covered:
            assert r["kept"] != r["base_failed"]  # nothing is repeated: the method has no objection


def test_pseudonyms(got, docs):
    whole = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), regex.V1)

    def replaced(line):
        out, at, n = "", 0, 0
        while m := whole.search(line, at):
            old, new = m[0], plain_pii(m.lastgroup, m[0], OPEN_KEY)
            if new == old:  # a card or IBAN that runs on: its longest valid beginning
                groups = re.split("[ -]", old)
                for k in range(len(groups) - 1, 0, -1):
                    part = old[: len("-".join(groups[:k]))]
                    kind = next((x for x in ("iban", "card") if regex.fullmatch(pii.PATTERNS[x], part, regex.V1)), None)
                    if kind and plain_pii(kind, part, OPEN_KEY) != part:
                        old, new = part, plain_pii(kind, part, OPEN_KEY)
                        break
            out, at, n = out + line[at : m.start()] + new, m.start() + len(old), n + (new != old)
        return out + line[at:], n

    for r in got("op4_pii"):
        text = docs[r["doc_id"]]["text"]
        lines = [replaced(x) for x in (text or "").split("\n")]
        assert (r["text"], r["n_replaced"]) == ((None, 0) if text is None else ("\n".join(x for x, _ in lines), sum(n for _, n in lines))), r["doc_id"]


def test_mix(got, docs):
    size = {d: len(words(r["text"])) for d, r in docs.items()}
    total, taken = Counter(), Counter()
    for d, r in docs.items():
        total[r["source"]] += size[d]
    want = targets(total)
    for r in got("op6_mix"):
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"], r["target"]) == (size[r["doc_id"]], total[s], pytest.approx(want[s])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in total)


def test_quality(got, docs):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    out = {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    right = []
    for r in got("op7_quality"):
        assert r["held_out"] == (r["doc_id"] in out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            right.append(r["predicted"] == labels[r["doc_id"]])
    assert len(right) > 10 and sum(right) >= 0.9 * len(right)


def test_packing(got, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got("op9_packing"):
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    n = 0
    for d, rows in pieces.items():
        ids = np.array(tokenizer.encode(docs[d]["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        n += len(ids)
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-n // 2048) + max(1, n // 2048 // 50)


def test_fingerprints(got, docs):
    rows = got("op10_simhash")
    assert all(r["fingerprint"] == f"{plain_fingerprint(docs[r['doc_id']]['text']):016x}" for r in rows)
    groups = components([*{int(r["fingerprint"], 16) for r in rows}], 3)
    first = {}
    for r in rows:
        f = int(r["fingerprint"], 16)
        group = next((g for g in groups if f in g), frozenset([f]))
        first[group] = min(first.get(group, r["doc_id"]), r["doc_id"])
        r["group"] = group
    assert all(r["component_id"] == first[r["group"]] for r in rows)


def test_whitening(got):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    check_whitened(got("op11_whiten"), [(r["vec_id"], r["embedding"]) for r in t])


def test_toxicity(got, docs):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    wrong = 0
    for r in got("op12_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"] and docs[r["doc_id"]]["lang"] == "en" and labels.get(r["doc_id"]) is not None:
            wrong += r["predicted"] != labels[r["doc_id"]]
    assert wrong <= 1


def test_audit_parts(got, docs):
    rows = got("op13_audit")
    parts = Counter(r["source"] or "" for r in docs.values())
    assert len(rows) == 600 * len(parts) and {r["part"] for r in rows} == set(parts)
    for r in rows:
        if r["step"] == 5:
            assert r["kept"] + sum(x["removed"] for x in rows if x["part"] == r["part"] and x["filter_order"] == r["filter_order"]) == parts[r["part"]]
            break
