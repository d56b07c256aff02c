"""Six ways to answer from documents too long for one call: map over pages, reduce per document, all inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lists import ordered_list
from sparkloom.functions.text import format_template, strip, substr0
from sparkloom.operators.ai import prompt
from sparkloom.operators.relational import majority_vote, top_k_per_group

SEPARATOR = "\n\n---\n\n"


def _joined(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    return df.groupBy(by).agg(F.array_join(ordered_list(order, text), SEPARATOR).alias("text"))


def search(pages: DataFrame, by: str, page: str, text: str, question: str, provider=None, is_relevant: Column | None = None) -> DataFrame:
    """The earliest page that answers: previews are asked first, and only pages said to matter get the full call."""
    hit = is_relevant if is_relevant is not None else F.upper(prompt(format_template(question + " Answer YES or NO.\n{}", substr0(text, 0, 200)), provider=provider)).startswith("YES")
    near = pages.filter(hit).withColumn("answer", prompt(format_template(question + "\n{}", text), provider=provider))
    plain = F.lower("answer")
    kept = near.filter(~plain.contains("not found") & ~plain.contains("no information"))
    return top_k_per_group(kept, [by], [F.col(page).asc()], 1, "_n").drop("_n")


def summarize(pages: DataFrame, by: str, page: str, text: str, instruction: str = "Summarize.", provider=None) -> DataFrame:
    """(by, summary): each page summarised, then the summaries of a document together."""
    mapped = pages.withColumn("_part", prompt(text, instruction, provider))
    return _joined(mapped, by, page, "_part").select(by, prompt("text", instruction, provider).alias("summary"))


def analyze(pages: DataFrame, by: str, page: str, text: str, aspect: str, provider=None) -> DataFrame:
    """(by, analysis): as :func:`summarize`, with one aspect to look for."""
    return summarize(pages, by, page, text, f"Analyze: {aspect}", provider).withColumnRenamed("summary", "analysis")


def classify(pages: DataFrame, by: str, text: str, labels: list[str], provider=None) -> DataFrame:
    """(by, label, votes): pages are labelled and the majority labels the document."""
    label = F.lower(strip(prompt(text, "Classify.", provider, choices=labels)))
    return majority_vote(pages.withColumn("label", label), [by], "label")


def extract(pages: DataFrame, by: str, text: str, instruction: str = "List items, one a line.", provider=None, lines: Column | None = None) -> DataFrame:
    """(by, item): the distinct non-empty lines of the answers to all pages."""
    answer = lines if lines is not None else prompt(text, instruction, provider)
    return pages.select(by, F.explode(F.split(answer, "\n", -1)).alias("_l")).select(by, strip("_l").alias("item")).filter("item <> ''").distinct()


def question_answer(pages: DataFrame, by: str, page: str, text: str, question: str, provider=None, is_relevant: Column | None = None) -> DataFrame:
    """(by, answer): pages that matter are answered from, and the answers made one."""
    hit = is_relevant if is_relevant is not None else F.upper(prompt(format_template(question + " Answer YES or NO.\n{}", substr0(text, 0, 200)), provider=provider)).startswith("YES")
    mapped = pages.filter(hit).withColumn("_part", prompt(format_template(question + "\n{}", text), provider=provider))
    return _joined(mapped, by, page, "_part").select(by, prompt("text", f"Synthesize: {question}", provider).alias("answer"))


def qa_chain(topics: DataFrame, topic: str, provider=None) -> DataFrame:
    """question, answer and judgement: three calls that build on one another."""
    out = topics.withColumn("question", prompt(format_template("Ask about {}", topic), provider=provider))
    out = out.withColumn("answer", prompt(format_template("{}", "question"), provider=provider))
    return out.withColumn("judgement", prompt(format_template("Q: {}\nA: {}\nIs this right?", "question", "answer"), provider=provider))
