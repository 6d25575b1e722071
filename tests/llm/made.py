"""Made documents with a signal to learn."""

import random


def labelled(spark, n=1200):
    """Documents, labels of most of them, and the truth: bad ones hold marked words."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows, truth = [], {}
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        truth[i] = i % 3 == 0
        if truth[i]:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["awful", "dreadful", "vile", "nasty"]))
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    return docs, spark.createDataFrame([(i, int(t)) for i, t in truth.items()], "doc_id long, toxic int"), truth
