"""Composite plans: lead lists from URL hits to ranked results, change cycles, and merges with feedback.

Every plan is a chain of lazy transforms; only the change cycle runs jobs, one small
aggregate for each candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import classify, dedupe, joins, rank
from ..session import computed


@dataclass
class LeadRules:
    """Rule sets of a lead pipeline; all are data."""

    blocked: Sequence[str] = ()
    keywords: Sequence[rules.Rule] = ()
    boosts: Sequence[rules.Rule] = ()
    boost_cap: int = 40
    grades: tuple[int, int] = (60, 40)
    columns: dict[str, Sequence[str]] = field(default_factory=lambda: {
        "url": ["url", "URL", "website", "最終URL"], "name": ["store_name", "shop_name", "店舗名", "display_name", "表示名"], "city": ["city", "市区町村", "area", "所在地"],
        "score": ["lead_score", "score", "リードスコア", "スコア"], "label": ["sales_label", "営業優先度", "label"],
    })


def prefilter(hits: DataFrame, r: LeadRules, per_domain: int = 15, seq: str = "seq") -> DataFrame:
    """URL hits worth fetching: web addresses, no junk, foreign or blocked ones, one of each normal form, the best paths of each domain."""
    u = F.col("url")
    named = computed(hits.where(urls.is_web_url(u)), {"_web": urls.normalize_web(u), "_domain": urls.domain_key(u), "_path": urls.path_priority(u)})
    kept = named.where(~urls.is_junk(u) & ~urls.is_foreign(u) & ~F.coalesce(urls.host_in(F.col("_domain"), r.blocked), F.lit(False)))
    once = dedupe.keep_first(kept, [F.col("_web")], [F.col(seq)])
    return rank.top_k(once, [F.col("_domain")], [F.col("_path"), F.col(seq)], per_domain, "domain_rank").drop("_web", "_domain", "_path")


def normalise(leads: DataFrame, r: LeadRules) -> DataFrame:
    """Leads of any header spelling in the lasting columns ``seq, url, url_strict, domain, name, name_key, city, score, label``."""
    p = lambda c: text.pick(leads, r.columns[c])
    seq = F.col("seq") if "seq" in leads.columns else F.monotonically_increasing_id().alias("seq")
    raw = computed(leads.select(seq, *leads.drop("seq").columns), {f"_{c}": p(c) for c in r.columns}).select("seq", *[f"_{c}" for c in r.columns])
    out = raw.select("seq", F.col("_url").alias("url"), text.sanitize(F.col("_name")).alias("name"), text.sanitize(F.col("_city")).alias("city"), text.score_0_100(F.col("_score")).alias("score"), F.col("_label").alias("label"))
    return computed(out, {"url_strict": urls.normalize_strict(F.col("url")), "domain": urls.domain_key(F.col("url")), "name_key": text.store_name_key(F.col("name"))})


def rules_score(low: Column, r: LeadRules) -> Column:
    """Score with the capped boosts of a text, within 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.col("_score") + rules.points(low, r.boosts, r.boost_cap))).cast("int")


def evaluate(leads: DataFrame, r: LeadRules) -> DataFrame:
    """Adds ``filter_reason``, boosted ``score`` and ``grade``; kept rows have the reason ''."""
    leads = computed(leads, {"_low": F.lower(F.concat_ws(" ", "url", "name"))})
    low = F.col("_low")
    word = rules.first_match(low, r.keywords)
    reason = rules.first_reason([(urls.host_in(F.col("domain"), r.blocked), F.concat(F.lit("domain:"), F.col("domain"))), (word.isNotNull(), F.concat(F.lit("keyword:"), word))])
    done = computed(leads.withColumnRenamed("score", "_score"), {"filter_reason": reason, "score": rules_score(low, r)}).drop("_low", "_score")
    return done.withColumn("grade", classify.grade(F.col("score"), *r.grades))


def lead_list(leads: DataFrame, r: LeadRules) -> DataFrame:
    """The whole plan: normalise, evaluate, drop filtered rows, keep the best of each address (else name and city, which may be missing), in presentation order by ``label_order, score``."""
    kept = evaluate(normalise(leads, r), r).where("filter_reason = ''")
    second = F.when(F.col("name") != "", F.concat_ws("|", F.col("name_key"), text.store_name_key(F.col("city")))).otherwise("")
    best = dedupe.keep_best_two_keys(kept, F.col("url_strict"), second, F.col("score"), F.col("seq"))
    return best.withColumn("label_order", rank.label_order(F.col("label")))


def with_feedback(leads: DataFrame, feedback: DataFrame, as_of: Column, key: str = "lead_id") -> DataFrame:
    """Leads with the latest feedback by identifier, else by domain, as the struct ``feedback``, and whether it is of the same day."""
    latest = dedupe.keep_latest(feedback, [F.col(key)], F.col("time"), F.col("seq"))
    by_domain = dedupe.keep_latest(feedback.where("domain <> ''"), [F.col("domain")], F.col("time"), F.col("seq"))
    side = latest.withColumn("_id", F.col(key)).withColumn("_domain", F.lit(None).cast("string")).unionByName(by_domain.withColumn("_id", F.lit(None).cast(dict(feedback.dtypes)[key])).withColumn("_domain", F.col("domain")))
    out = joins.fallback_join(leads, side, [(key, "_id"), ("domain", "_domain")], "feedback")
    return out.withColumn("same_day", F.coalesce(F.to_date("feedback.time") == F.to_date(as_of), F.lit(False)))


@dataclass
class Step:
    """Result of one candidate in a change cycle."""

    name: str
    passed: bool
    progress: float
    accepted: bool


def change_cycle(leads: DataFrame, candidates: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], measure: Callable[[DataFrame], DataFrame], gate: Callable[[dict, dict], bool], stop_after: int = 2, epsilon: float = 1e-12) -> list[Step]:
    """Tries changes one after another on what was accepted so far: a change is accepted if the gate holds and the measured ``progress`` rises.

    ``measure`` gives one row with a column ``progress``. Ends after ``stop_after`` changes in a row without acceptance.
    """
    out: list[Step] = []
    now, base, idle = leads, measure(leads).first().asDict(), 0
    for name, change in candidates:
        trial = change(now)
        after = measure(trial).first().asDict()
        passed = bool(gate(base, after))
        accepted = passed and after["progress"] > base["progress"] + epsilon
        out.append(Step(name, passed, after["progress"], accepted))
        if accepted:
            now, base, idle = trial, after, 0
        else:
            idle += 1
            if idle >= stop_after:
                break
    return out
