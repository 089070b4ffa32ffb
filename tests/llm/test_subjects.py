import numpy as np

from quillgraph.llm import subjects as S

AREAS = [("cooking", "food"), ("music", "songs"), ("software", "programs")]
DOCS = "doc_id bigint, text string, title string, source string, repo string, node_id string, row string, share int"
COOK = ["Each broth points at its garlic.", "Whisk the dough in the saucepan.", "Every recipe has a flour and an oven.", "The stew and the vinegar are kept together."]
PLAY = ["The choir and the violin are kept together.", "Every album has a melody.", "An octave may carry several chords of the orchestra.", "Do not confuse the soprano with the rhythm."]
FILL = ["Updated after review.", "See the wiki for more.", "Numbers are rounded to two places."]


def run(spark, docs, labels=(), areas=AREAS, **kw):
    d = spark.createDataFrame([(i, t, title, s, "a-repo", None, "clash", 1) for i, t, title, s in docs], DOCS)
    a = spark.createDataFrame(areas, "subject string, description string")
    lab = spark.createDataFrame(list(labels), "doc_id bigint, subject string, annotator int")
    return {(r.doc_id, r.subject) for r in S.subjects(d, a, lab, **kw).collect()}


def corpus():
    docs = [(i, "\n".join(COOK[j % 4] for j in range(i, i + 3)), None, "readme") for i in range(40)]
    return docs + [(100 + i, " ".join(PLAY[j % 4] for j in range(i, i + 3)), None, "issue") for i in range(40)]


def test_shares(spark):
    docs = corpus() + [
        (200, "\n".join([*COOK, *PLAY]), None, "readme"),  # both
        (201, "\n".join([*COOK, *COOK[:3], PLAY[0]]), None, "readme"),  # music in passing
        (202, "\n".join(FILL), None, "readme"), (203, "", None, None), (204, None, None, None), (205, "  \n ", None, None),
        (206, "# Violin choir melody\n\n" + FILL[0], "Violin choir melody", "readme"),  # only a heading
        (207, (" ".join(COOK) + "\n") * 2000, None, "readme"), (0, PLAY[0] + " " + PLAY[1], None, "readme"),
    ]
    told = [(1, " Cooking ", 1), (1, "cooking", 2), (101, "nonsense", 1), (None, "music", 1)] + [(i, "cooking", 1) for i in range(2, 9)] + [(100 + i, "MUSIC", 1) for i in range(2, 9)]
    got = run(spark, docs, told)
    assert {(200, "cooking"), (200, "music"), (201, "cooking"), (207, "cooking"), (0, "cooking"), (0, "music")} <= got
    assert not {(201, "music")} & got and not any(i in (202, 203, 204, 205, 206) for i, _ in got)
    assert {i for i, s in got if s == "cooking"} >= set(range(40)) and {i for i, s in got if s == "music"} >= set(range(100, 140))


def invented(rng, subjects, docs):
    """Documents of subjects and words that exist nowhere, in sentences that all subjects share: (rows, truth)."""
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(4))
    words = {s: [word() for _ in range(25)] for s in subjects}
    forms = ["Each {} points at its {}.", "See `lib/{}_{}.py` for more.", "The {} and the {} are kept together.", "A {} without a {} is listed apart.", "Every {} has a {} and a {}."]
    rows, truth = [], set()
    for i in range(docs):
        about = list(rng.choice(subjects, size=2 if rng.random() < 0.2 else 1, replace=False)) if rng.random() < 0.9 else []
        said = [f.format(*rng.choice(words[a], size=3)) for a in about for f in rng.choice(forms, size=4)] + list(rng.choice(FILL, size=2))
        rng.shuffle(said)
        rows.append((i, "\n".join(said), "Late column", ["readme", "issue"][i % 2]))
        truth |= {(i, a) for a in about}
    return rows, truth


def test_unseen_subjects_on_held_out_documents(spark):
    rng = np.random.default_rng(8)
    subjects = ["falconry", "pottery", "tides", "weaving"]
    rows, truth = invented(rng, subjects, 500)
    told = [(i, s, 1) for i, s in sorted(truth) if i % 4 == 0]
    told = [(i, subjects[(subjects.index(s) + 1) % 4] if rng.random() < 0.08 else s, a) for i, s, a in told]  # some are wrong
    areas = [(s, "an area of its own") for s in subjects]
    got = {(i, s) for i, s in run(spark, rows, told, areas) if i % 4}
    want = {(i, s) for i, s in truth if i % 4}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_a_lexicon_too_large_to_broadcast_gives_the_same(spark):
    rows, truth = invented(np.random.default_rng(9), ["falconry", "pottery", "tides"], 120)
    told, areas = [(i, s, 1) for i, s in sorted(truth) if i % 3 == 0], [(s, "") for s in ("falconry", "pottery", "tides")]
    assert run(spark, rows, told, areas, most_bytes=0) == run(spark, rows, told, areas) != set()


def test_empty_tables(spark):
    assert run(spark, []) == set() and run(spark, corpus()[:2], areas=[]) == set()


def test_statements():
    text = '"""Values in v. describe the case, never the court.\n\n    Why is it empty? Because no note was given.\n    # Title\n* 0.1: Sample: a=1, b=2.\n// `x_y(z)` returns the a or nothing.\n"""'
    got = [s for _, s in S.statements(text)]
    assert got == ["Values in v. describe the case, never the court.", "Why is it empty? Because no note was given.", "Sample: a=1, b=2.", "`x_y(z)` returns the a or nothing."]
    assert S.statements(None) == [] and S.plain_words("triageDiagnosis of unit-tests") == ["triage", "diagnosi", "of", "unit-test"]


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(3)
    n, size = 4, 20_000
    truth = rng.integers(0, n + 1, size)
    votes = np.zeros((size, 4), int)
    for j, (agree, silent) in enumerate([(0.85, 0.1), (0.5, 0.45), (0.6, 0.2), (0.2, 0.7)]):
        r = rng.random(size)
        votes[:, j] = np.where(r < agree, truth, np.where(r < agree + silent, 0, rng.integers(1, n + 1, size)))
        votes[truth == 0, j] = np.where(rng.random((truth == 0).sum()) < 0.03, rng.integers(1, n + 1, (truth == 0).sum()), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, learnt = S.label_model(patterns, counts.astype(float), n)
    best = {tuple(p): q.argmax() for p, q in zip(patterns, post)}
    assert np.mean([best[tuple(v)] == t for v, t in zip(votes, truth)]) > 0.9
    assert learnt["agree"][0] > learnt["agree"][2] > learnt["agree"][3]
