import random

from pyspark.sql import functions as F

from samples import sentence
from versegrid.llm import repeated_units as R


def brute(rows, least):
    """Units by plain splitting, occurrences ranked by (id, offset)."""
    seen, gone = {}, set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for start, stop, line, n, whole, _ in R.spans(text or "", least):
            name = " ".join(text[start:stop].split()).lower()
            first = seen.setdefault(name, (doc_id, start))
            if first != (doc_id, start):
                gone.add((doc_id, start, stop, n, *first, line, whole))
    lines = {(g[0], g[6]) for g in gone if g[7]}
    return {g[:6] for g in gone if g[7] or (g[0], g[6]) not in lines}


def cases():
    rng = random.Random(4)
    passage = ". ".join(sentence(rng, 12) for _ in range(5)) + "."
    rows = [(i, f"{sentence(rng, 9)}. {sentence(rng, 3)} {passage if i % 3 == 0 else sentence(rng, 20)} {sentence(rng, 4)}\n"
                f"{'COMMON  line of rather many words here, eight' if i % 2 else sentence(rng, 30)}\nshort") for i in range(40)]
    return rows + [(90, None), (91, ""), (92, "\n\n . \n"), (7, rows[7][1]), (93, rows[5][1]), (94, (passage + "\n") * 3), (None, rows[6][1])]


def test_against_brute_force(spark):
    rows = cases()
    got = R.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {tuple(r) for r in got} == brute(rows, R.LEAST)


def test_cleaned_text_keeps_offsets(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1))
    out = R.cleaned(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for k, t in rows if k == r.doc_id)
        left = "" if text is not None else None
        if text is not None:
            drop = set().union(*[range(a, b) for a, b in r.removed], set())
            left = "".join(c for i, c in enumerate(text) if i not in drop)
        assert r.text == left


def test_short_lines_and_scripts_without_spaces(spark):
    zh, ja, th = "我们今天在北京的一家小餐馆里吃了很多好吃的菜。", "昨日は友達と一緒に東京の美術館へ行きました！", "วันนี้เราไปตลาดเพื่อซื้อผลไม้และผักสดมากมาย"
    hi = "यह एक छोटा सा वाक्य है जो दो बार आता है।"
    rows = [(1, f"Short line.\n}}\n{zh}甲乙\n{ja}丙\n{th} กขค\n{hi}अ"), (2, f"short  LINE.\n}}\n子丑。{zh}寅\n卯。{ja}\nงจฉ {th}\nआ।{hi}"),
            (3, f"x {'a' * 50}. y"), (4, f"z. {'A' * 50}. w"), (5, f"x {'b' * 50}. y"), (6, f"z. x {'b' * 50}. w\nOne. Yes. Two"), (7, "3. Yes. 4")]
    got = R.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert {(r.doc_id, text[r.doc_id][r.start:r.stop]) for r in got} == {
        (2, "short  LINE."), (2, "}"), (2, zh), (2, ja), (2, th), (2, hi), (6, f"x {'b' * 50}.")}


def test_empty(no_docs, clashing):
    assert R.repeated(no_docs).count() == 0 and R.cleaned(no_docs).count() == 0
    assert R.repeated(clashing).count() > 0
