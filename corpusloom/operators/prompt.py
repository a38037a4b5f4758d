"""Prompts as string expressions over arrays of retrieved records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as T


def example_lines(examples: Column, direction: str) -> Column:
    """The first 5 of array<struct<texto_inga, texto_es>> as lines."""
    a, b = ("texto_inga", "texto_es") if direction == "inga2es" else ("texto_es", "texto_inga")
    name = {"texto_inga": "INGA", "texto_es": "ESPANOL"}
    text = lambda r, c: F.coalesce(r[c], F.lit(""))
    return F.array_join(F.transform(F.slice(examples, 1, 5), lambda r: F.concat(F.lit(f"- {name[a]}: "), text(r, a), F.lit(f"\n  {name[b]}: "), text(r, b))), "\n")


def _section(title: str, records: Column, body: Column) -> Column:
    return F.when(F.size(records) > 0, F.concat(F.lit(title), body))


def prompt(sentence: Column, direction: str, lexicon: Column | None = None, grammar: Column | None = None, examples: Column | None = None) -> Column:
    """The user prompt: sections that hold something, a blank line between them, the request last."""
    known = lambda r, c: F.coalesce(r[c], F.lit("?"))
    parts = []
    if lexicon is not None:
        words = F.transform(F.slice(lexicon, 1, 5), lambda r: F.concat(F.lit("- "), known(r, "lema"), F.lit(" ("), known(r, "cat"), F.lit("): "), known(r, "glosa")))
        parts.append(_section(T.PROMPT_LEXICON, lexicon, F.array_join(words, "\n")))
    if grammar is not None:
        notes = F.transform(F.slice(grammar, 1, 3), lambda r: F.concat(F.lit("- ("), known(r, "fuente"), F.lit(") "), F.substring(F.coalesce(r["text"], F.lit("")), 1, 400)))
        parts.append(_section(T.PROMPT_GRAMMAR, grammar, F.array_join(notes, "\n")))
    if examples is not None:
        parts.append(_section(T.PROMPT_EXAMPLES, examples, example_lines(examples, direction)))
    ask = F.concat(F.lit(T.PROMPT_HEADS[direction] + ":\n\n"), sentence)
    if not parts:
        return ask
    # With a context whose sections are all empty the blank line stays.
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n\n"), ask)


def system_prompt(direction: Column) -> Column:
    return F.when(direction == "inga2es", T.SYSTEM_PROMPTS["inga2es"]).otherwise(T.SYSTEM_PROMPTS["es2inga"])


def refinement(base: Column, draft: Column) -> Column:
    return F.concat(base, F.lit("\n\n" + T.PROMPT_DRAFT[0]), draft, F.lit("\n\n" + T.PROMPT_DRAFT[1]))
