from weftgraph.llm import pii


def term_words(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: [x.split(":")[1:] for x in r["spans"].split(",") if x.startswith("term:")] for r in pii.find(df).collect()}
    return [{texts[i][int(s) : int(e)] for s, e in out[i]} for i in range(len(texts))]


FILLER = [f"filler{i} common words here" for i in range(900)]


def test_disclosing_terms_go_everywhere(spark):
    gap = " common" * 40
    texts = FILLER + ["Zyxwyn zyx@corp.example" + gap + " zyxwyn"] + [f"zyx@corp.example{gap} zyxwyn" for _ in range(3)] + ["common Zyxwyn words", "common zyxwynx words"]
    got = term_words(spark, texts)
    assert [sorted(x) for x in got[900:]] == [["Zyxwyn", "zyxwyn"], ["zyxwyn"], ["zyxwyn"], ["zyxwyn"], ["Zyxwyn"], []] and not any(got[:900])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.sanitise(df).where("doc_id = 904").first()["text"] == "common [TERM] words"


def test_rare_entities_are_judged(spark):
    texts = FILLER + [f"Quorvex member{i}@quorvex{i}.example common" for i in range(4)] + [f"common blenhost x{i}@blen.example" for i in range(4)]
    got = term_words(spark, texts)
    assert all("Quorvex" in got[i] for i in range(900, 904)) and all("blenhost" in got[i] for i in range(904, 908)) and not any(got[:900])


def test_repeated_rows_count_alike(spark):
    texts = FILLER + ["Zyxwyn zyx@corp.example"] * 3 + ["zyxwyn common"] * 2
    df = spark.createDataFrame([(0 if 900 <= i < 903 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert not pii.find(df).where("spans like '%term%'").count()  # 3 of 5 rows
    df = df.where("doc_id not in (904)").unionAll(df.where("text like 'Zyxwyn%'"))
    assert pii.find(df).where("spans like '%term%'").count() == 7  # 6 of 7 rows
