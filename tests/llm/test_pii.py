import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import pii, pii_table
from quillspark.llm.chain import viterbi


def found(text):
    return {(label, text[a:b]) for _, label, a, b in pii.find(pii.tagger(), pa.array([text]))}


def test_held_out_labels():
    tokens, gold = pii._labelled(pii_table.rows(2, seed=991))
    got = pii.tagger().labels(tokens)
    for k in range(1, len(pii.LABELS)):
        hit = ((got == k) & (gold == k)).sum()
        assert hit / (gold == k).sum() > 0.95 and hit / (got == k).sum() > 0.95


def test_pruned_decoding_is_the_best_labelling():
    model = pii.tagger()
    tokens, _ = pii._labelled(pii_table.rows(1, seed=5))
    got = model.labels(tokens)
    rows = model.rows(tokens)
    place = np.arange(len(rows)) + pii.REACH * (tokens.sequence + 1)
    padded = np.zeros(place[-1] + pii.REACH + 1, np.int64)
    padded[place] = rows
    score = sum(model._table[padded[place + d], d + pii.REACH] for d in range(-pii.REACH, pii.REACH + 1))
    begin = np.flatnonzero(np.append(True, tokens.sequence[1:] != tokens.sequence[:-1]))
    length = np.diff(np.append(begin, len(rows)))
    want = viterbi(score, begin, length, model.transitions, model.transitions[0], model.transitions[:, 0])
    assert (got == want).mean() > 0.9999


@pytest.mark.parametrize("text, mention", [
    ("Contact: Maria Lentz, tel. 020 7946 0321, maria.lentz@example.org.", ("EMAIL", "maria.lentz@example.org")), ("Contact: Maria Lentz, tel. 020 7946 0321, maria.lentz@example.org.", ("PHONE", "020 7946 0321")),
    ("write to <mailto:m.lentz(at)example.net>", ("EMAIL", "m.lentz(at)example.net")), ("Le soussigné Maria Lentz, demeurant Flat 3, 12 rue des Lilas, 75011 Paris, SSN 912-11-2345, atteste la réception.", ("ID_NUMBER", "912-11-2345")),
    ("{\"contact\": \"LENTZ Maria\", \"phone\": \"(212) 555-0199\"}", ("PHONE", "(212) 555-0199")),
])
def test_mentions(text, mention):
    assert mention in found(text)


def test_no_mentions():
    for text in ["Order 977-23-11832 covers 52 units @ 29.50 each.", "Penalty cap: 23 520 000 euros.", "Each sealed pump extends the notice under clause 3.2.", "", "   "]:
        assert found(text) == set()


def test_tables(spark):
    df = spark.createDataFrame([("x", "ask for Mr Peter Lund.", 1), (None, None, 2), ("y", "", 3)], "entity_type string, t string, c0 int")
    rows = pii.mentions(df, "t").collect()
    assert [(r.entity_type, r.start_pos, r.end_pos, r.c0) for r in rows] == [("NAME", 11, 21, 1)]
    texts = {r.c0: r.redacted for r in pii.with_placeholders(df, "t").collect()}
    assert texts == {1: "ask for Mr [NAME].", 2: None, 3: ""}
    assert pii.mentions(df.where("false"), "t").count() == 0


def test_unseen_sentences():
    """Trained on half of the sentence patterns, tested on the other half: what the tagger knows of sentences it has never seen."""
    model = pii.train(pii_table.rows(10, part=(1, 2)))
    tokens, gold = pii._labelled(pii_table.rows(3, seed=99, part=(0, 2)))
    got = model.labels(tokens)
    for k in range(1, len(pii.LABELS)):
        hit = ((got == k) & (gold == k)).sum()
        assert hit / (gold == k).sum() > 0.75 and hit / (got == k).sum() > 0.8, pii.LABELS[k]
