"""Deterministic stand-in models for tests and registered queries.

They are pure functions of their inputs (so de-duplication can never change a
result) and each has an exact SQL twin in the oracle.  Real deployments pass
their own factories with the same call signature.

generator   suggest -> every prompt line as a bullet;
            detail  -> a recipe layout built from the prompt lines;
            other   -> '[<task>] <prompt>';
            fails with 'boom' when the prompt length is a multiple of 10.
translator  '<tgt>' + text; fails when a code is outside the tokenizer's
            language list (the gate lets te/rw/sn/st through, the model
            does not know them).
"""

from __future__ import annotations

import pandas as pd

from recipeflow.functions import constants as K

NO_TOKENIZER = ("te", "rw", "sn", "st")
TOKENIZER_LANGS = tuple(c for c in K.MT_LANGS if c not in NO_TOKENIZER)


def stub_generate(task: str, prompt: str) -> str:
    if len(prompt) % 10 == 0:
        raise RuntimeError("boom")
    if task == "suggest":
        return "- " + prompt.replace("\n", "\n- ")
    if task == "detail":
        return (
            "Ingredients:\n- " + prompt.replace("\n", "\n- ") + "\n\nSteps:\n1. " + prompt.replace("\n", "\n2. ")
        )
    return "[" + task + "] " + prompt


def stub_translate(text: str, src: str, tgt: str) -> str:
    if tgt not in TOKENIZER_LANGS:
        raise KeyError(f"unknown target language {tgt}")
    if src not in TOKENIZER_LANGS:
        raise KeyError(f"unknown source language {src}")
    return "<" + tgt + ">" + text


class StubGenerator:
    """Factory: ``StubGenerator()()`` returns the per-partition model."""

    def __call__(self):
        return self

    def complete_batch(self, pdf: pd.DataFrame):
        texts, errors = [], []
        for task, prompt in zip(pdf["task"], pdf["prompt"]):
            try:
                texts.append(stub_generate(task, prompt))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                texts.append(None)
                errors.append(str(e))
        return texts, errors


class StubTranslator:
    def __call__(self):
        return self

    def complete_batch(self, pdf: pd.DataFrame):
        texts, errors = [], []
        for text, src, tgt in zip(pdf["text"], pdf["src"], pdf["tgt"]):
            try:
                texts.append(stub_translate(text, src, tgt))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                texts.append(None)
                errors.append(str(e).strip("'"))
        return texts, errors


class CountingGenerator(StubGenerator):
    """The stub generator, counting model calls into a Spark accumulator."""

    def __init__(self, acc):
        self.acc = acc

    def complete_batch(self, pdf: pd.DataFrame):
        self.acc.add(len(pdf))
        return super().complete_batch(pdf)
