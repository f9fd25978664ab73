"""Label masks over whole texts, against plain Python."""

from epiframe.plans.queries import QUERIES

HEADER = ["<h1>", "<h2>", "<h3>"]
LONG = " ".join(f"w{'x' * (k % 7)}" for k in range(3000))
TEXTS = [(0, LONG), (1, LONG), (39, LONG), (41, "a  b " + LONG), (45, "one two"), (46, "one two"), (50, LONG + " <h1> <h2> <h3> last words"), (55, ""), (56, "")]


def brute(doc, text):
    words = text.split(" ")
    at = min(len(words), doc % 40)
    tokens = words if doc % 5 == 0 else words[:at] + HEADER + words[at:]
    found = [k + 3 for k in range(len(tokens) - 2) if tokens[k : k + 3] == HEADER]
    start = found[0] if found else len(tokens)
    kept = [len(t) for t in tokens[start:] if t]
    return doc, start, len(kept), sum(kept)


def test_whole_texts(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["label_mask_subsequence"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(*r) for r in TEXTS)
