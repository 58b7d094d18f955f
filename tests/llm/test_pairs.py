import itertools
import random

import numpy as np
import pytest

from textquarry.llm import pairs
from textquarry.llm.crf import Crf

from .heldout_pairs import PAIRS


def test_crf_against_enumeration():
    r = random.Random(2)
    crf = Crf(3, 12)
    crf.theta = np.random.default_rng(0).normal(size=crf.theta.shape)
    f = 12
    for _ in range(20):
        units = [r.sample(range(12), r.randrange(1, 4)) for _ in range(r.randrange(1, 5))]

        def score(tags):
            s = crf.theta[f + 3][tags[0]] + crf.theta[f + 4][tags[-1]]
            s += sum(crf.theta[i][t] for u, t in zip(units, tags) for i in u)
            return s + sum(crf.theta[f + a][b] for a, b in zip(tags, tags[1:]))

        best = max(itertools.product(range(3), repeat=len(units)), key=score)
        assert crf.tag(units) == list(best)
    many = [[r.sample(range(12), r.randrange(1, 4)) for _ in range(r.randrange(1, 5))] for _ in range(30)]
    assert crf.tag_all(many) == [crf.tag(u) for u in many] and crf.tag_all([]) == []


def test_crf_learns_transitions():
    r = random.Random(1)
    data = []
    for _ in range(300):
        tags = [r.randrange(2)]
        while len(tags) < 5:
            tags.append(1 - tags[-1])
        data.append(([[t if i == 0 else 2] for i, t in enumerate(tags)], tags))  # only the first unit tells
    crf = Crf(2, 3).fit(data, rounds=80)
    assert all(crf.tag(u) == t for u, t in data)


def test_crf_gradient_and_optimum():
    r = random.Random(3)
    data = [([r.sample(range(12), r.randrange(1, 4)) for _ in range(n)], [r.randrange(3) for _ in range(n)]) for n in (1, 2, 3, 3, 4) * 6]
    crf = Crf(3, 12)
    loss = crf._loss([*data, *data[:7]], 1e-2)
    at, step = np.random.default_rng(0).normal(size=crf.theta.shape), 1e-5
    for i in np.ndindex(at.shape):
        d = np.zeros_like(at)
        d[i] = step
        assert abs((loss(at + d)[0] - loss(at - d)[0]) / (2 * step) - loss(at)[1][i]) < 1e-6
    assert np.abs(loss(crf.fit([*data, *data[:7]], 60, 1e-2).theta)[1]).max() < 1e-5


@pytest.fixture(scope="module")
def model():
    return pairs.fit([])


Q = "Which option sets the limit of the parser?"
G = "Welche Option bestimmt die Grenze des Lesers?"
CASES = [
    (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "N/A", "empty"), (Q, "```\n```", "empty"), (Q, "…", "empty"), (Q, "[no output]", "empty"),
    (Q, "`max_limit`", None), (Q, "12 ms", None), (Q, "core/io/parser.py", None), (Q, "Check these settings:\n- `a_b`\n- `c_d`", None),
    (Q, "The loader reads every file below the root. Each worker keeps its own", "truncated"), (Q, "The loader reads every file.\n- ", "truncated"),
    (Q, "The loader reads every file.\n\n```python\ndef f():\n    return 1", "truncated"), (Q, "The loader reads every file.\n\n```\nx = 1\n```", None),
    (Q, "I'm sorry, but I can't answer this from the excerpts shown", "refusal"), (G, "Dazu fehlen mir leider die Angaben.", "refusal"),
    (Q, "The reader can't open parser without `a_b`.", None), (Q, Q, "copy"), (Q, "> " + Q, "copy"), (Q, Q.upper(), "copy"), (Q, Q + "\n" + Q, "copy"),
    (Q, Q + "\n\nSet `max_items` to 40 when the cache is small.", None), (Q, "Der Lader liest jede Datei unter der Wurzel und wartet auf den nächsten Lauf.", "language"),
    (G, "The loader reads every file below the root.", "language"), (G, "Der Lader liest jede Datei unter der Wurzel.", None),
    (Q, "The log line reads \"Der Lader wartet auf den nächsten Lauf.\" in that case.", None), (None, "The loader reads every file.", None), (None, "", "empty"),
]


@pytest.mark.parametrize("question,answer,want", CASES)
def test_cases(model, question, answer, want):
    assert model.defect(question, answer) == want


def test_held_out_pairs(model):
    """Pairs made with another seed than the training pairs."""
    names = {pairs.REFUSAL: "refusal", pairs.ECHO: "copy", pairs.FOREIGN: "language", pairs.UNFINISHED: "truncated", pairs.ANSWER: None}
    made = [(q, a, names[last]) for q, a, last, _ in pairs.training_pairs([], model, seed=99)]
    right = sum(model.defect(q, a) == want for q, a, want in made)
    assert right >= 0.95 * len(made)


def test_pairs_written_apart(model):
    """Against the fixed examples alone; with a table's rows the model knows more. A language that isn't known is never a copy."""
    got = model.defects([(q, a) for q, a, _ in PAIRS])
    assert sum(d == want for d, (_, _, want) in zip(got, PAIRS)) >= 0.85 * len(PAIRS)
    assert not [a for d, (_, a, want) in zip(got, PAIRS) if want == "language" and d == "copy"]
    assert sum(d == "language" for d, p in zip(got, PAIRS) if p[2] == "language") >= 0.85 * sum(p[2] == "language" for p in PAIRS)


def test_model_is_kept(spark, monkeypatch):
    rows = [(Q, "The loader reads every file below the root and keeps it.")]
    made = pairs.stored_model(spark, rows)
    monkeypatch.setattr(pairs, "fit", None)  # not trained again
    assert pairs.stored_model(spark, rows).defects([(q, a) for q, a, _ in CASES]) == made.defects([(q, a) for q, a, _ in CASES])


def test_clauses_cover_the_answer():
    text = "# H\n\nOne. Two? `a. b` three.\n- item\n> quoted\n```py\nx. y\n```\nEnd"
    assert [k for k, _ in pairs.clauses(text)] == ["heading", "plain", "plain", "plain", "plain", "item", "quoted", "code", "plain"]
    assert pairs.clauses("a\n```\nb")[-1] == ("open_code", "```\nb")


def test_table(spark):
    rows = [("1", Q, "", 1), ("1", Q, "", 1), ("2", Q, Q, 1), ("3", None, None, 1), (None, Q, "N/A", 1), ("4", Q, "12 ms", None), ("5", Q, "The loader reads. " * 20000, 1)]
    df = spark.createDataFrame(rows, "question_id string, question string, answer string, defect int")
    got = sorted(((r.question_id or "", r.defect) for r in pairs.defective_pairs(df).collect()))
    assert got == [("", "empty"), ("1", "empty"), ("2", "copy"), ("3", "empty")]
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_words_of_late_clauses_are_learned():
    answer = "Der Lader liest jede Datei unter der Wurzel. " * 8 + "Die Zwischenablage wartet."
    rows = [(f"Welche Option bestimmt die Grenze des Lesers {i}?", answer) for i in range(6)]
    assert "zwischenablage" in pairs.fit(rows).lexicon


def _held(monkeypatch):
    """Models that ``defective_pairs`` gets, as they come."""
    made, get = [], pairs.stored_model
    monkeypatch.setattr(pairs, "stored_model", lambda *a: made.append(get(*a)) or made[-1])
    return made


def test_all_rows_are_learned_from(spark, monkeypatch):
    """More rows than any sample had, each with a word of its own, and a long answer with one at its end."""
    made = _held(monkeypatch)
    own = ["".join(p) for p in itertools.product("bdfgklmnrs", "aeiou", "lmnrst", "aeiou")][:900]
    rows = [(str(i), G, f"Der Lader liest {w}. " * 8) for i, w in enumerate(own)]
    late = "Der Lader liest jede Datei unter der Wurzel. " * 600 + "Die Zwischenablage wartet. " * 8
    got = pairs.defective_pairs(spark.createDataFrame([*rows, ("long", G, late)], "question_id string, question string, answer string"))
    assert not [w for w in [*own, "zwischenablage"] if w not in made[0].lexicon]
    assert got.count() == 0


def test_fields_of_buckets_are_joined(spark, monkeypatch):
    """One bucket gives what ``fit`` gives; several give one model that knows the features of each and judges as well."""
    answers = ["Der Lader liest jede Datei.", "Er wartet auf den nächsten Lauf.", "The loader reads every file below the root.", "Each worker keeps its own copy of the table."]
    rows = [(G if a[:2] in ("De", "Er") else Q, f"{a} {b}") for a in answers for b in answers if (a[:2] in ("De", "Er")) == (b[:2] in ("De", "Er"))]
    alone = pairs.fit(rows)
    one = pairs.stored_model(spark, rows * 2)
    assert one.names == alone.names and one.lexicon.keys() == alone.lexicon.keys()
    assert np.allclose(one.crf.theta, alone.crf.theta, atol=1e-3)
    monkeypatch.setattr(pairs, "BUCKET_ROWS", 3)
    two = pairs.stored_model(spark, rows)
    assert not np.allclose(two.crf.theta, alone.crf.theta, atol=1e-3) and two.names.keys() >= alone.names.keys()
    assert two.defects([(q, a) for q, a, _ in CASES]) == [want for _, _, want in CASES]


def test_joined_weights():
    """The mean goes by how often a bucket has the feature; a bucket without it has no say."""
    a, b = ({"#3": np.asarray([w / pairs._GRAIN * n] * 5 + [n])} for w, n in ((1.0, 30), (3.0, 10)))
    joined = pairs._joined(pairs.Model(), {"#3": a["#3"] + b["#3"], "tag 0": np.asarray([2 / pairs._GRAIN * 7] * 5 + [7]), "bias": a["#3"]})
    assert joined.crf.theta[3].tolist() == [1.5] * 5 and joined.crf.theta[4096 + 1].tolist() == [2.0] * 5 and joined.crf.theta[joined.names["bias"]].tolist() == [1.0] * 5


def test_pieces_are_whole():
    r = random.Random(5)
    parts = ["One sentence of some length. ", "Another\n", "```py\n" + "x = 1\n" * 50 + "```\n", "- item\n", "\n\n", "w" * 300 + " "]
    for _ in range(50):
        text = "".join(r.choices(parts, k=r.randrange(1, 300)))
        made = pairs.pieces(text)
        assert "".join(made) == text and all(len(pairs._FENCE.findall(p)) % 2 == 0 for p in made[:-1])
    assert len(pairs.pieces("One sentence. " * 1000)) > 5 and pairs.pieces("") == [""]
