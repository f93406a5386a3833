"""Screening questions in words, compiled to a plan and from that to a DataFrame.

A question is split into clauses; each is a filter, an order or something that
can't be answered. What can't be answered makes the whole abstain: a plan with
``unsupported`` terms isn't run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How comparisons are said.
SAID = {"more than": ">", "over": ">", "above": ">", "at least": ">=", "fewer than": "<", "less than": "<", "under": "<", "at most": "<="}
SIGNS = (">=", "<=", ">", "<", "=")
SCALES = {"billion": 1e9, "million": 1e6, "bn": 1e9, "m": 1e6}
FORMS = ("ASA", "AS", "ANS", "DA", "ENK", "NUF", "SA", "STI", "BRL")
#: Terms that no permitted or proven field answers, and why.
UNANSWERED = {
    "sentiment": "sentiment is not qualified",
    "glassdoor": "Glassdoor data is not available through a permitted connector",
    "linkedin": "LinkedIn-derived employee data is not available through a permitted connector",
    "traffic": "website traffic is not available through a qualified provider",
    "reviews": "review data is not available through a qualified provider",
    "buzz": "social buzz is not available through a qualified provider",
    "without a website": "missing or unverified website evidence does not prove that a company has no website",
}
#: Fixed value: what is said where nothing in a question is known.
NOTHING_KNOWN = "No supported criterion was recognized."
#: Fixed value: a ranking gives at most so many; a question without one gives all that fit.
MOST = 100
#: The part of a profile that each field is proven by.
MODULES = {"municipality": "registry", "legal_form": "registry", "employees": "registry", "industry": "registry", "revenue": "financials", "annual_result": "financials", "latest_accounts": "financials", "website": "website"}


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object


@dataclass
class Plan:
    question: str
    filters: list[Filter] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    limit: int | None = None
    unsupported: list[str] = field(default_factory=list)

    @property
    def executable(self) -> bool:
        return bool(self.filters or self.order) and not self.unsupported

    @property
    def reason(self) -> str | None:
        """Why the question isn't answered; null if it is."""
        return None if self.executable else "; ".join(self.unsupported) or NOTHING_KNOWN

    @property
    def modules(self) -> list[str]:
        """The parts of profiles that an answer rests on."""
        used = {rule.field for rule in self.filters} | ({self.order[0]} if self.order else set())
        return sorted({MODULES[name] for name in used})


_PHRASES = "|".join(SAID)
_AMOUNT = r"(?:nok |kroner )?(?P<n>\d[\d.,]*)\s*(?P<s>billion|million|bn|m)?\b"


def _compared(low: str, name: str, said_of: str) -> tuple[str, float] | None:
    """``(operator, value)`` of ``more than 5 employees``, ``revenue over 2 million`` or ``employees >= 5``."""
    for pattern in (rf"\b(?P<o>{_PHRASES})\s+{_AMOUNT}\s+(?:(?:nok|kroner|registered|in)\s+)*{said_of}\b", rf"\b{said_of}\s*(?:of |is )?(?P<o>{'|'.join(SIGNS)}|{_PHRASES})\s*{_AMOUNT}"):
        found = re.search(pattern, low)
        if found:
            digits = found["n"].rstrip(".,")
            digits = re.sub(r"[.,](?=\d{3}(?:\D|$))", "", digits) if re.search(r"[.,]\d{3}[.,]", digits) else digits.replace(",", ".")
            return SAID.get(found["o"], found["o"]), float(digits) * SCALES.get(found["s"] or "", 1)
    return None


def parse(question: str) -> Plan:
    """The plan of a question; clauses it doesn't know are passed over, those that can't be answered are kept with the reason."""
    text = " ".join(question.split())
    low = text.lower()
    plan = Plan(question)
    plan.unsupported = [why for term, why in UNANSWERED.items() if term in low]

    place = re.search(r"\b(?:in|municipality(?:\s+is|\s*=)?)\s+([\w .'-]+?)(?=\s+(?:with|without|and|having|that|where|top)\b|[,;?!]|$)", low)
    if place:
        plan.filters.append(Filter("municipality", "eq", place[1].strip().upper()))
    form = re.search(rf"\b(?:legal|organisation)\s+form\s*(?:is\s|=)?\s*({'|'.join(FORMS)})\b".lower(), low) or re.search(rf"\b({'|'.join(FORMS)})\s+compan", text)
    if form:
        plan.filters.append(Filter("legal_form", "eq", form[1].upper()))
    for name, said_of in (("employees", "employees?"), ("revenue", "revenue")):
        found = _compared(low, name, said_of)
        if found:
            plan.filters.append(Filter(name, *found))
    if re.search(r"\bunprofitable\b|\bloss[- ]making\b|\bnegative annual result\b", low):
        plan.filters.append(Filter("annual_result", "<", 0.0))
    elif re.search(r"\bprofitable\b|\bpositive annual result\b", low):
        plan.filters.append(Filter("annual_result", ">", 0.0))
    if re.search(r"\b(?:with|has|have)\s+(?:an?\s+)?(?:official\s+)?website\b", low):
        plan.filters.append(Filter("website", "present", None))
    if re.search(r"\b(?:with|has|have)\s+(?:annual\s+)?accounts\b", low):
        plan.filters.append(Filter("latest_accounts", "present", None))
    trade = re.search(r"\bindustry(?:\s+contains|\s+is|\s*=)?\s+[\"']([^\"']+)[\"']", low)
    if trade:
        plan.filters.append(Filter("industry", "contains", trade[1].strip()))
    top = re.search(r"\btop\s+(\d+)\s+by\s+(revenue|employees)\b", low)
    if top:
        plan.order, plan.limit = (top[2], True), min(int(top[1]), MOST)
    return plan


def predicate(rule: Filter) -> Column:
    """One filter as an expression that is never null: what isn't known doesn't fit."""
    column = F.col(rule.field)
    made = {
        "eq": lambda: F.lower(column) == str(rule.value).lower(),
        "contains": lambda: F.contains(F.lower(column), F.lit(str(rule.value).lower())),
        "present": lambda: column.isNotNull() & (column.cast("string") != ""),
        "missing": lambda: column.isNull() | (column.cast("string") == ""),
        "=": lambda: column == rule.value,
        ">": lambda: column > rule.value,
        "<": lambda: column < rule.value,
        ">=": lambda: column >= rule.value,
        "<=": lambda: column <= rule.value,
    }[rule.operator]()
    return F.coalesce(made, F.lit(False))


def run(profiles: DataFrame, plan: Plan, key: str = "organisation_number") -> DataFrame:
    """All profiles that fit; under a ranking the first of it, unknown values last, then by key. None if it abstains.

    A field that the profiles don't have is unknown for all of them.
    """
    if not plan.executable:
        return profiles.limit(0)
    used = [rule.field for rule in plan.filters] + ([plan.order[0]] if plan.order else [])
    missing = [name for name in dict.fromkeys(used) if name not in profiles.columns]
    known = profiles.withColumns({name: F.lit(None).cast("double") for name in missing})
    rows = known.where(reduce(lambda a, b: a & b, map(predicate, plan.filters), F.lit(True)))
    if plan.order:
        rows = rows.orderBy(F.col(plan.order[0]).desc_nulls_last(), key).limit(plan.limit)
    return rows.drop(*missing)


def screen(profiles: DataFrame, question: str, key: str = "organisation_number") -> DataFrame:
    return run(profiles, parse(question), key)


def outcome(profiles: DataFrame, question: str, key: str = "organisation_number") -> DataFrame:
    """One row: ``question, abstained, reason, result_count``."""
    plan = parse(question)
    return run(profiles, plan, key).agg(F.count("*").alias("result_count")).select(F.lit(question).alias("question"), F.lit(not plan.executable).alias("abstained"), F.lit(plan.reason).cast("string").alias("reason"), "result_count")


def cited(results: DataFrame, evidence: DataFrame, plan: Plan, key: str = "organisation_number") -> DataFrame:
    """``results`` with ``module, source_url, retrieved_at, content_sha256``: a row for each part of the profile the answer rests on.

    ``evidence`` has ``module`` beside the columns of evidence; of several
    records the one retrieved last holds. A part without evidence is null.
    """
    last = evidence.groupBy(F.col(key).alias("_key"), "module").agg(F.max_by(F.struct("source_url", "retrieved_at", "content_sha256"), F.struct("retrieved_at", "row_id")).alias("_last"))
    asked = results.withColumn("module", F.explode(F.array(*map(F.lit, plan.modules)).cast("array<string>")))
    return asked.join(last.withColumnRenamed("module", "_module"), (F.col(key) == F.col("_key")) & (F.col("module") == F.col("_module")), "left").select(*asked.columns, "_last.source_url", "_last.retrieved_at", "_last.content_sha256")


#: Topics of questions about one company, by the words that ask for them.
TOPICS = {"employees": "employee|staff|people|ansatte", "address": "address|where|located|adresse", "website": "website|web|nettside", "accounts": "account|financ|revenue|regnskap", "form": "legal form|kind of company|foretaksform"}


def answer(profiles: DataFrame, question: str, key: str = "organisation_number", fields: dict[str, str] | None = None) -> DataFrame:
    """``key, topic, value``: the facts of each profile that a question asks for; all topics where it names none."""
    fields = fields or {"employees": "employees", "address": "municipality", "website": "website", "accounts": "latest_accounts", "form": "legal_form"}
    asked = [t for t, words in TOPICS.items() if re.search(words, question.lower())] or list(TOPICS)
    facts = F.array(*(F.struct(F.lit(t).alias("topic"), F.col(fields[t]).cast("string").alias("value")) for t in asked if fields[t] in profiles.columns))
    return profiles.select(key, F.inline(facts)).where("value is not null")
