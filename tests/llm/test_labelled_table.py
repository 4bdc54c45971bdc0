"""The labelled table of operator 6 is a sample: neither sort order nor frequency crowds labelled spans out."""

import random

from llm.conftest import make
from roadpulse.llm import pii

PHONE = "call me at +1 (555) 555-1234 or write to user{}@mail{}.example.com today please"


def learns(table):
    model = pii.train(table)
    base, added = pii.label_batch(["reach jane.roe @ site7.example.com or so"], model)[0]
    return base == [] and [x[1] for x in added] == [0]


def test_a_repeated_line_does_not_fill_the_table(spark):
    rows = [(i, "(12) 3 44 5") for i in range(3500)] + [(4000 + i, PHONE.format(i, i % 9)) for i in range(200)]
    table = pii.labelled_table(make(spark, rows))
    assert learns(table)
    assert sum(n for _, y, n in table if not any(y)) == 3500 and len(table) < 50


def test_many_windows_that_sort_first_do_not_fill_the_table(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_WINDOWS", 300)
    monkeypatch.setattr(pii, "SPAN_WINDOWS", 100)
    rnd = random.Random(4)
    odd = ["(" + " ".join("".join(rnd.choice("1(#-aB") for _ in range(5)) + "2" for _ in range(4)) for _ in range(1500)]
    mails = ["write " + rnd.choice("ABab(#*;") + rnd.choice("ab#;!") + f" to user{i}@mail{i % 9}.example.com " + rnd.choice(["or", "Or", "-", ";"])
             + " " + rnd.choice(["so", "(so)", "So!", "so;"]) for i in range(600)]
    table = pii.labelled_table(make(spark, list(enumerate(odd + mails))))
    plain = [s for s, y, _ in table if not any(y)]
    assert 200 < len(plain) < 400 and 0 < len(table) - len(plain) < 200
    assert learns(table)
