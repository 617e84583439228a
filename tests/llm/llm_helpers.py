"""Frames and texts for the tests of the training-data operators."""

CLASHES = ["k", "c", "id", "label", "words", "fingerprint", "node", "start", "end", "row", "spans", "part", "__text", "__k",
           "__c", "__row", "__print", "__spans", "a.b", "text.x", "__both"]


def documents(spark, rows):
    """documents with the given (doc_id, text) rows and extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows], schema)


def prose(rng, words):
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    out = []
    for _ in range(words):
        out.append(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeioulnrstdm", k=rng.randint(3, 9))))
        if rng.random() < 0.08:
            out[-1] += "."
        if rng.random() < 0.05:
            out[-1] += "\n"
    return " ".join(out)
