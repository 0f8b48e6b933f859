from gaugework.llm.sanitise import sanitise


def test_terms_of_a_value_held_by_one_text(spark):
    texts = [f"plain note {n % 7} about the weather in march" for n in range(400)]
    texts += ["Zorblax wrote in march to zed@once.org"] + ["Vantor came, ask +1 (743) 555-3824 or van@two.org"] * 3 + ["we wrote and came to ask or not"] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sanitise(frame).collect()}
    assert {s["value"] for s in rows[400]["term_spans"]} == {"Zorblax"}
    # One text is never enough to remove a term here: 1 - 1 / log2(406) = 0.88.
    assert {s["kind"] for s in rows[400]["term_spans"]} == {"generalised"}
    assert rows[400]["sanitised"] == "[NAME] wrote in march to [EMAIL]"
    # log2(406 / (2 * 3)) / log2(406 / 3) = 0.86; the copies count as one text.
    assert rows[401]["sanitised"] == rows[403]["sanitised"] == "[NAME] came, ask [PHONE] or [EMAIL]"
    assert all(rows[n]["sanitised"] == texts[n] for n in [*range(400), 404])


def test_value_of_every_document(spark):
    frame = spark.createDataFrame([(n, f"note {n} to a@b.cc") for n in range(5)], "doc_id long, text string")
    assert sorted(r["sanitised"] for r in sanitise(frame).collect()) == [f"note {n} to [EMAIL]" for n in range(5)]


def test_many_values_in_one_text(spark):
    values = " ".join(f"user{n}@list.org" for n in range(200))
    words = " ".join(f"word{n}" for n in range(200))
    rows = [(0, f"{values} {words}")] + [(n, "another note") for n in range(1, 300)]
    found = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").selectExpr("size(base_spans) as b", "size(term_spans) as t").first()
    assert (found["b"], found["t"]) == (200, 200)
