import random

from versegrid.llm import language as L

VOICE = {"aa": ["the", "wher", "ing", "oul"], "bb": ["sch", "ein", "ung", "ß"], "cc": ["ción", "ll", "que", "os"]}


def corpus(spark, n=60):
    rng = random.Random(9)
    rows = [(f"{lang}{i}", " ".join("".join(rng.choices(parts, k=2)) for _ in range(30)), lang if i % 3 else None)
            for lang, parts in VOICE.items() for i in range(n)]
    rows += [("n", None, "aa"), ("e", "", "bb"), ("x", "12 -- 34", None), ("u", "12 -- 34", "dd")]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string")


def test_held_out_rows_are_recognised(spark):
    df = corpus(spark)
    learned = L.prototypes(df)
    assert set(learned) == {"aa", "bb", "cc", ""}
    got = {r.doc_id: r for r in L.predictions(df, learned).collect()}
    assert all(got[f"{lang}{i}"].lang_pred == lang for lang in VOICE for i in range(0, 60, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[k].lang_pred for k in "nexu"} == {"und"}


def test_partitioning_does_not_matter(spark):
    df = corpus(spark)
    a, b = L.prototypes(df.repartition(7)), L.prototypes(df.coalesce(1))
    assert all((a[k] == b[k]).all() for k in a)


def test_nothing_to_learn_and_filter(spark, clashing, no_docs):
    df = corpus(spark)
    assert {r.lang_pred for r in L.predictions(df, L.prototypes(df.filter("lang = 'none'"))).collect()} == {"und"}
    learned = L.prototypes(df)
    assert L.recognised(df, learned).filter("doc_id in ('n', 'e', 'x', 'u')").count() == 0
    out = L.recognised(clashing, L.prototypes(clashing))
    assert out.columns == clashing.columns and not {80, 81, 82} & {r.doc_id for r in out.collect()}
    assert L.recognised(no_docs, learned).count() == 0


def test_letters_above_the_base_plane(spark):
    rng = random.Random(3)
    adlam = [chr(c) for c in range(0x1E922, 0x1E944)]
    rows = [(f"g{i}", " ".join("".join(rng.choices(adlam, k=4)) for _ in range(30)), "ff" if i else None) for i in range(9)]
    df = corpus(spark).unionByName(spark.createDataFrame([*rows, ("m", "\U00020000\U00020001 𝒳𝒴", None)], "doc_id string, text string, lang string"))
    learned = L.prototypes(df)
    got = {r.doc_id: r.lang_pred for r in L.predictions(df, learned).collect()}
    assert got["g0"] == "ff" and got["m"] != "und" and got["n"] == "und"
    assert L.bundle("𝒳") is not None and L.bundle("\U0001F600") is None


def test_random_letters_and_unlearned_languages_go(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    letters = [("r%d" % i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)), None) for i in range(20)]
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    other = [("fi", finnish, None), ("ru", "Все люди рождаются свободными и равными в своем достоинстве и правах.", None)]
    df = corpus(spark)
    known = {r.doc_id for r in df.collect()} - {"n", "e", "x", "u"}
    mixed = df.unionByName(spark.createDataFrame(letters + other, "doc_id string, text string, lang string"))
    assert {r.doc_id for r in P.known_language(spark, mixed, str(tmp_path)).collect()} == known
