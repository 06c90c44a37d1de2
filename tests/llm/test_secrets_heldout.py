"""The Markov models on tokens that they weren't trained on."""

import numpy as np
from pyspark.sql import functions as F

from covenant.llm import secrets

ALPHABETS = {
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "small": "abcdefghijklmnopqrstuvwxyz0123456789",
}


def test_recall_and_false_finds_on_held_out_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(secrets.samples(docs))
    random, made = np.random.default_rng(5), []
    for name, letters in ALPHABETS.items():
        made += [(len(made) + k, name, "".join(random.choice(list(letters), random.integers(24, 41)))) for k in range(200)]
    words = sorted({w for r in docs.limit(300).collect() for w in (r.text or "").split() if w.isascii() and w.isalpha() and len(w) > 3})
    join = [lambda ws: "_".join(ws).lower(), lambda ws: "".join(w.title() for w in ws), lambda ws: "-".join(ws).lower()]
    for k in range(600):
        made.append((len(made), "ordinary", join[k % 3](list(random.choice(words, 4)))))
    frame = spark.createDataFrame([(k, f"see {token} here") for k, _, token in made], "doc_id bigint, text string")
    found = {r.doc_id for r in secrets.scan(frame, model).collect() if r.spans}
    share = {name: sum(k in found for k, n, _ in made if n == name) / sum(n == name for _, n, _ in made) for name in [*ALPHABETS, "ordinary"]}
    print(share)
    ratios = sorted(r.x for r in frame.where("doc_id >= 1000").select(secrets.ratio(F.regexp_extract("text", "see (.*) here", 1), model).alias("x")).collect())
    print("highest of ordinary names", ratios[-1])
    assert all(share[n] >= 0.95 for n in ALPHABETS) and share["ordinary"] <= 0.01
