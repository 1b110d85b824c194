import hashlib
import random
import re

from versegrid.llm import decontaminate as D
from samples import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, ids = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            n = min(13, len(w))
            windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
            for s in range(len(own) - n + 1):
                if tuple(own[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    ids.add("" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(df, bench).select("doc_id", "found.*").collect()
    return sorted((tuple(r) for r in got), key=repr)


def cases():
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice([1, 3, 7, 12, 13, 14, 40]))) for i in range(25)]
    items += [(90, None), (91, ""), (None, sentence(rng, 20)), (92, items[20][1]), (92, items[20][1]), (93, "ab ab " * 20)]
    docs = [(i, sentence(rng, rng.randint(0, 60))) for i in range(20)]
    for i in range(40):
        source = words(rng.choice(items)[1])
        cut = rng.randint(0, max(0, len(source) - 5))
        docs.append((100 + i, f"{sentence(rng, rng.randint(0, 200))}, {' '.join(source[cut:cut + rng.randint(5, 30)]).upper()}! {sentence(rng, 9)}"))
    docs += [(500, None), (501, ""), (502, "..."), (103, docs[23][1]), (None, docs[30][1]), (503, "ab " * 3000)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_long_items_only(spark):
    docs, items = cases()
    items = [x for x in items if len(words(x[1])) >= 13]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, docs[:3], []) == brute(docs[:3], [])
    assert run(spark, [], items) == []


def test_filter_keeps_clean_rows_and_columns(spark, clashing):
    bench = spark.createDataFrame([(1, clashing.filter("doc_id = 40").first().text)], "item_id long, text string")
    out = D.decontaminated(clashing, bench)
    assert out.columns == clashing.columns
    left = {r.doc_id for r in out.collect()}
    assert 40 not in left and {0, 1, 80, 81, 84} <= left
