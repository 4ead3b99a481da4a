"""Every stage of the pipeline against a plain reading of its rules, on the given
documents with hard rows among them: nulls in any column, empty and very long
texts, repeated rows, personal data, and extra columns with clashing names."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cartograph.llm.common import Scratch
from cartograph.llm.queries import vocabulary

D = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
EXTRA = ["kept", "rank", "size", "fingerprint", "component_id", "piece", "_slot", "token", "text_hash"]


def fails_base(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return len(words) < 20 or 100 * len(repeated) > 30 * len(words)


def simhash(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    base = docs.orderBy("doc_id").collect()
    long = " ".join(f"word{i * 7919 % 5003} of {i}" for i in range(40000))
    good = next(r.text for r in base if not fails_base(r.text))
    hard = [{"text": None}, {"text": ""}, {"text": " \n\t"}, {"text": long}, {"text": good, "lang": None, "source": None},
            {"text": good, "doc_id": None}, {"text": good, "doc_id": None}, {"text": good + " write to ann.lee@mail.example or 4111 1111 1111 1111"},
            {"text": long + " call +1 (512) 555-0199 from 192.168.0.12 now"}]
    rows = [tuple({**base[0].asDict(), "doc_id": 10 ** 6 + i, **h}.values()) for i, h in enumerate(hard)]
    rows += [tuple(base[5]), tuple(base[5]), tuple(base[6])]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(c))
    scratch = Scratch(spark, "edges")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(scratch.save(f(spark, out[-1], D), name))
    assert all(d.columns == docs.columns for d in out[1:-1])
    return [d.collect() for d in out]


def ids(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_quality_rules_drop_what_fails_the_base(stages):
    raw, good = stages[:2]
    assert not ids(good) - ids(raw)
    assert not [r.doc_id for r in good if fails_base(r.text)]
    assert len(good) > 0.5 * sum(not fails_base(r.text) for r in raw)
    assert all(r[c] == c for r in good for c in EXTRA)


def test_one_document_of_each_near_duplicate_class_stays(stages):
    good, single = stages[1:3]
    prints = [simhash(r.text) for r in good]
    group = list(range(len(good)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    bits = np.array(prints, dtype=np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(bits ^ np.uint64(p)) <= 3).tolist():
            group[top(i)] = top(j)
    classes = defaultdict(list)
    for i, r in enumerate(good):
        classes[top(i)].append((r.doc_id, r.text))
    left = ids(single)
    for members in classes.values():
        assert sum(min(left[m], 1) for m in set(members)) == 1, members[:3]
    assert len(single) == len(classes)


def test_personal_data_goes_and_clean_texts_stay(stages):
    single, clean = stages[2:4]
    assert Counter(r.doc_id for r in single) == Counter(r.doc_id for r in clean)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before = {r.doc_id: r.text for r in single}
    assert any(email.search(t) for t in before.values())
    for r in clean:
        assert not email.search(r.text) and "4111 1111 1111 1111" not in r.text
        assert "555-0199" not in r.text and "192.168.0.12" not in r.text
        if not re.search(r"[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mix_takes_each_document_at_most_three_times(stages):
    clean, mix = stages[3:5]
    have, taken = ids(clean), ids(mix)
    assert all(have[k] and n <= 3 * have[k] for k, n in taken.items())
    words = lambda rows, s: sum(len(WORD.findall(r.text or "")) for r in rows if r.source == s)
    sources = sorted({r.source for r in clean if r.source is not None}) + [None] * any(r.source is None for r in clean)
    size = [words(clean, s) for s in sources]
    weight = [1 + i % 3 for i in range(len(sources))]
    target, open_ = [0.0] * len(sources), set(range(len(sources)))
    while open_:  # excess over three times a source's size is shared again
        rest = sum(size) - sum(t for i, t in enumerate(target) if i not in open_)
        share = {i: rest * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * size[i]}
        for i in over or set(open_):
            target[i] = 3 * size[i] if over else share[i]
            open_.discard(i)
    most = max(len(WORD.findall(r.text or "")) for r in clean)
    for s, t in zip(sources, target):
        assert abs(words(mix, s) - t) <= 2 * most + 0.02 * t, (s, words(mix, s), t)


def test_packing_holds_every_token_once(stages):
    mix, packed = stages[4:6]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want, of = Counter(), {}
    for r in mix:
        if r.text not in of:
            of[r.text] = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(of[r.text]), 2048):
            part = np.array(of[r.text][at:at + 2048], dtype="<u4")
            want[r.doc_id, at // 2048, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
