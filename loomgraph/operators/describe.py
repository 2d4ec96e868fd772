"""Descriptions: parsing of generated answers, offline generator and judge, cached generation, experiment driver."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "v1"


class Generator(Protocol):
    """Answers to prompts; a model-backed one loads its model once for each worker."""

    name: str

    def __call__(self, prompts: list[str]) -> list[str]: ...


class TopWords:
    """The offline generator: three candidates made of a prompt's most frequent longer words."""

    name = "top-words"

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            counts: dict[str, int] = {}
            for w in p.lower().split():
                if len(w) > 4 and w.isalpha():
                    counts[w] = counts.get(w, 0) + 1
            top = sorted(counts, key=lambda w: (-counts[w], w))[:9]
            out.append("\n".join("- documents about " + " ".join(top[i::3]) for i in range(3)))
        return out


def parsed(raw: Column) -> Column:
    """Candidates of an answer: the JSON object's list, else bullet lines of three words or more (at most five), else the
    first 200 characters."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    json = F.from_json(found, "struct<candidates:array<string>>")["candidates"]
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    bullets = F.slice(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 3), 1, 5)
    return F.when(F.size(json) > 0, json).when(F.size(bullets) > 0, bullets).otherwise(F.array(F.substring(raw, 1, 200)))


def prompt_key(prompt: Column, model: str, system: str = "describe") -> Column:
    return F.sha1(F.concat(F.lit(VERSION), F.lit(model), F.lit(system), prompt))


def generated(prompts: DataFrame, cache: DataFrame | None, generator: Generator) -> tuple[DataFrame, DataFrame]:
    """(answers of all ``prompts`` (comm, prompt), new cache rows): hits are joined, only misses are generated."""
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt"), generator.name))
    misses = (keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")).select("key", "prompt").distinct()

    def answer(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "raw": generator(pdf.prompt.tolist())})

    new = misses.mapInPandas(answer, "key string, raw string")
    known = new if cache is None else cache.select("key", "raw").unionByName(new)
    return keyed.join(known, "key").select("comm", "key", "raw", parsed(F.col("raw")).alias("candidates")), new


def judged(answers: DataFrame, n_classes: int, tries: int = 3) -> DataFrame:
    """The first valid answer of each item within ``tries`` attempts (item, attempt, answer, stop_reason), else null."""
    valid = (F.col("stop_reason") == "end_turn") & F.col("answer").between(0, n_classes - 1)
    first = F.min(F.when(valid & (F.col("attempt") <= tries), F.struct("attempt", "answer")))
    return answers.groupBy("item").agg(first["answer"].alias("answer"), F.max("attempt").alias("attempts"))
