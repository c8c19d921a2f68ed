"""Text classification behind a pluggable backend: prompts, calls with retries, response parsing, usage and cost.

The default backend is offline and deterministic, so plans and tests need no network. A backend
is any picklable object with ``complete(system, user) -> (response, input_tokens, output_tokens)``; it runs on the executors.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.session import small_batches
from tidemark.sources.schemas import CLASSIFICATIONS, HARM_VERTICALS

MODES = ("zero_shot", "few_shot")
# fixed values: USD per million tokens in and out, and default models
PRICES = {"anthropic": (3.00, 15.00), "openai": (2.50, 10.00), "groq": (0.05, 0.08)}
DEFAULT_MODELS = {"anthropic": "claude-sonnet-4-6", "openai": "gpt-4o", "groq": "llama-3.1-8b-instant"}
BASE_URLS = {"anthropic": "https://api.anthropic.com/v1", "openai": "https://api.openai.com/v1", "groq": "https://api.groq.com/openai/v1"}
#: What rows say that no provider has answered.
OFFLINE = ("offline", "word-list")
#: What each vertical covers, in one sentence; replace by the platform's own policy text.
POLICIES = {
    "sexual_content_minors": "Any content that sexualises or exploits people under 18, or solicits such content.",
    "violent_extremism": "Content that incites, praises, recruits for or helps to plan terrorism or mass violence.",
    "self_harm_suicide": "Content that instructs in, encourages or romanticises self-harm or suicide.",
    "influence_operations": "Coordinated deception at scale: invented personas, fabricated campaigns, hidden sponsors.",
    "platform_abuse": "Fraud, spam, account takeover, fake engagement and other circumvention of platform rules.",
}
#: Labelled examples of each vertical for few-shot prompts, in own words; replace by the platform's own.
EXAMPLES = {
    "sexual_content_minors": (
        ("Which picture books suit a class of nine-year-olds?", False, "A question about reading; nothing sexual."),
        ("[a message that asks for sexual images of a child; removed]", True, "Solicits sexual content of a minor."),
        ("How should a school report a suspicion of abuse?", False, "Protective information."),
    ),
    "violent_extremism": (
        ("Why did the empire fall apart in 1918?", False, "A question about history."),
        ("Brothers, take up arms, they must all be wiped out, write to me to join.", True, "Incites and recruits for mass violence."),
        ("Do exit programmes for extremists work?", False, "About prevention."),
    ),
    "self_harm_suicide": (
        ("What helps against low mood in winter?", False, "Seeks help for well-being."),
        ("I have decided to end it tonight, tell me the surest way.", True, "States intent and asks for a method."),
        ("Who answers the phone at a crisis line?", False, "About support services."),
    ),
    "influence_operations": (
        ("How do newsrooms check quotes?", False, "About journalism."),
        ("Set up forty local-sounding accounts that all repeat this story before the vote.", True, "Plans invented personas to deceive voters."),
        ("Which laws require sponsors of adverts to be named?", False, "A question about rules."),
    ),
    "platform_abuse": (
        ("My account was locked, how do I get back in?", False, "A request for support."),
        ("Selling aged accounts and five thousand followers, cheap, they pass every check.", True, "Trades in accounts and fake engagement."),
        ("What does two-factor login protect from?", False, "About security."),
    ),
}
PARSED = "violates_policy string, confidence string, key_signals string, reasoning string"


class Backend(Protocol):
    def complete(self, system: str, user: str) -> tuple[str, int, int]: ...


class RateLimited(Exception):
    """The provider asks to slow down."""


class ProviderError(Exception):
    """A passing failure of the provider."""


@dataclass(frozen=True)
class OfflineBackend:
    """Deterministic answers from words and a hash of the text."""

    words: tuple[str, ...] = ("kill", "attack", "fraud", "spam", "fake", "hate")

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        text = user.rsplit("Content: ", 1)[-1].lower()
        found = [w for w in self.words if w in text.split()]
        base = 0.85 if found else 0.15
        confidence = round(base + (crc32(text.encode()) % 1000) / 10_000, 4)
        answer = {"violates_policy": bool(found), "confidence": confidence, "key_signals": found, "reasoning": "lexical match" if found else "no match"}
        return json.dumps(answer), len((system + user).split()), len(json.dumps(answer).split())


@dataclass(frozen=True)
class ChatBackend:
    """A chat-completions endpoint over HTTP (never used by tests)."""

    url: str
    api_key: str = field(repr=False)
    model: str

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        got = _post(f"{self.url}/chat/completions", body, {"Authorization": f"Bearer {self.api_key}"})
        return got["choices"][0]["message"]["content"], got["usage"]["prompt_tokens"], got["usage"]["completion_tokens"]


@dataclass(frozen=True)
class MessagesBackend:
    """A messages endpoint over HTTP, with the system prompt in a field of its own (never used by tests)."""

    url: str
    api_key: str = field(repr=False)
    model: str
    max_tokens: int = 512

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        got = _post(f"{self.url}/messages", body, {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"})
        return got["content"][0]["text"], got["usage"]["input_tokens"], got["usage"]["output_tokens"]


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    from urllib.error import HTTPError, URLError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"}), timeout=60) as response:
            return json.load(response)
    except HTTPError as error:
        raise (RateLimited if error.code == 429 else ProviderError)(str(error)) from error
    except URLError as error:
        raise ProviderError(str(error)) from error


def backend_for(provider: str, api_key: str, model: str, base_url: str | None = None) -> Backend:
    """The backend that speaks a provider's protocol."""
    return (MessagesBackend if provider == "anthropic" else ChatBackend)(base_url or BASE_URLS[provider], api_key, model)


def system_prompt(category: str, policies: dict[str, str] | None = None) -> str:
    policy = (policies or POLICIES)[category]
    return (
        f"You judge whether content violates one policy of a platform.\n\nPolicy: {category.replace('_', ' ').title()}\n{policy}\n\n"
        'Answer with one JSON object only: {"violates_policy": true or false, "confidence": number from 0 to 1, "key_signals": [phrases quoted from the content], "reasoning": "one or two sentences"}'
    )


def user_prompts(texts: DataFrame, mode: str, examples: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``texts`` with ``user_prompt``: the content, after labelled ``examples`` (text, label, reasoning, position) in few-shot mode."""
    content = F.concat(F.lit("Content: "), F.coalesce(F.col(text), F.lit("")))
    if mode != "few_shot":
        return texts.withColumn("user_prompt", content)
    if examples is None:
        raise ValueError("few-shot prompts need examples")
    shown = F.to_json(F.struct(F.col("label").alias("violates_policy"), F.when(F.col("label"), 0.95).otherwise(0.05).alias("confidence"), F.array().cast("array<string>").alias("key_signals"), "reasoning"))
    block = examples.select("position", F.concat(F.lit("Content: "), "text", F.lit("\nResponse: "), shown).alias("e")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "e"))), lambda x: x["e"]), "\n\n").alias("_examples"))
    return texts.crossJoin(F.broadcast(block)).withColumn("user_prompt", F.concat(F.lit("Labelled examples:\n\n"), F.col("_examples"), F.lit("\n\nNow judge this:\n\n"), content)).drop("_examples")


def example_rows(spark: SparkSession, category: str) -> DataFrame:
    """The shipped examples of a vertical: text, label, reasoning, position."""
    return spark.createDataFrame([(*row, k) for k, row in enumerate(EXAMPLES[category])], "text string, label boolean, reasoning string, position int")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in * price_in / 1_000_000 + tokens_out * price_out / 1_000_000


def parse_responses(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """``label``, ``confidence``, ``key_signals``, ``reasoning`` from model answers, fences stripped.

    Missing keys take defaults (false, .5, none, empty); text that is no JSON object takes them all, with the reasoning ``Parse error``.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    trimmed = strip(F.coalesce(F.col(raw), F.lit("")))
    inner = F.when(trimmed.startswith("```"), F.regexp_replace(F.element_at(F.split(trimmed, "```"), 2), "^json", "")).otherwise(trimmed)
    clean = strip(inner)
    fine = clean.startswith("{") & F.json_object_keys(clean).isNotNull()
    field_ = lambda name: F.get_json_object(clean, f"$.{name}")
    truthy = F.lower(F.coalesce(field_("violates_policy"), F.lit("false"))) == "true"
    confidence = F.coalesce(field_("confidence").try_cast("double"), F.lit(0.5))
    signals = F.coalesce(F.from_json(field_("key_signals"), "array<string>"), F.array().cast("array<string>"))
    return df.select(
        "*",
        F.when(fine, truthy).otherwise(False).alias("label"),
        F.when(fine, confidence).otherwise(0.5).alias("confidence"),
        F.when(fine, signals).otherwise(F.array().cast("array<string>")).alias("key_signals"),
        F.when(fine, F.coalesce(field_("reasoning"), F.lit(""))).otherwise("Parse error: not a JSON object").alias("reasoning"),
    )


def with_retries(call: Callable[[], tuple[str, int, int]], max_retries: int, sleep: Callable[[float], None]) -> tuple[str, int, int]:
    """Waits of 5 (rate limit) or 2 (provider) seconds times 2**attempt; other errors pass through."""
    for attempt in range(max_retries):
        try:
            return call()
        except RateLimited:
            sleep(5 * 2**attempt)
        except ProviderError:
            sleep(2 * 2**attempt)
    raise RuntimeError(f"no answer after {max_retries} attempts")


class HarmClassifier:
    """Classifies texts through a provider (given its ``api_key``), any ``backend``, or, with neither, offline by a word list.

    Offline rows say so in provider and model, and cost nothing.
    """

    def __init__(self, spark: SparkSession, provider: str = "anthropic", model: str | None = None, backend: Backend | None = None, api_key: str | None = None, base_url: str | None = None, max_retries: int = 3, requests_per_minute: float = 50, policies: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep):
        if provider not in PRICES:
            raise ValueError(f"unknown provider {provider!r}; one of {sorted(PRICES)}")
        self.spark, self.provider, self.model = spark, provider, model or DEFAULT_MODELS[provider]
        self.backend = backend or (backend_for(provider, api_key, self.model, base_url) if api_key else OfflineBackend())
        self.max_retries, self.sleep, self.prices = max_retries, sleep, PRICES[provider]
        if isinstance(self.backend, OfflineBackend):
            (self.provider, self.model), self.prices = OFFLINE, (0.0, 0.0)
        self.requests_per_minute, self.policies = requests_per_minute, policies or POLICIES

    def _check(self, category: str, mode: str) -> None:
        if category not in self.policies:
            raise ValueError(f"unknown category {category!r}; one of {sorted(self.policies)}")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")

    def batch_classify(self, texts: DataFrame, harm_category: str, mode: str = "zero_shot", examples: DataFrame | None = None, parallel: int | None = None, id_cols: tuple[str, ...] = ()) -> DataFrame:
        """One CLASSIFICATIONS row a text, in parallel, after the ``id_cols`` of ``texts``; a failed call gives a row of nulls with ``error``.

        Few-shot prompts take ``examples``, or else those shipped for the vertical.

        The request rate is shared out over ``parallel`` tasks (offline backends are not throttled).
        """
        self._check(harm_category, mode)
        small_batches(self.spark)
        if mode == "few_shot" and examples is None:
            if harm_category not in EXAMPLES:
                raise ValueError(f"no examples for {harm_category!r}")
            examples = example_rows(self.spark, harm_category)
        prompts = user_prompts(texts.select(*id_cols, "text"), mode, examples)
        offline = isinstance(self.backend, OfflineBackend)
        if not offline:
            prompts = prompts.repartition(parallel or 1)
        wait = 0.0 if offline else 60.0 * (parallel or 1) / self.requests_per_minute
        backend, system, tries, sleep = self.backend, system_prompt(harm_category, self.policies), self.max_retries, self.sleep

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for text, prompt in zip(batch["text"], batch["user_prompt"]):
                    if wait:
                        sleep(wait)
                    now = datetime.now(timezone.utc).isoformat()
                    try:
                        raw, n_in, n_out = with_retries(lambda p=prompt: backend.complete(system, p), tries, sleep)
                        rows.append((text, raw, n_in, n_out, now, None))
                    except Exception as error:  # noqa: BLE001  any failure of one call is that row's error
                        rows.append((text, None, 0, 0, now, str(error)))
                answers = pd.DataFrame(rows, columns=["text", "raw_response", "input_tokens", "output_tokens", "timestamp", "error"])
                yield pd.concat([batch[list(id_cols)].reset_index(drop=True), answers], axis=1)

        kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in id_cols)
        answered = prompts.mapInPandas(run, kinds + "text string, raw_response string, input_tokens long, output_tokens long, timestamp string, error string")
        parsed, failed, (price_in, price_out) = parse_responses(answered), F.col("error").isNotNull(), self.prices
        unless_failed = lambda c: F.when(~failed, c)
        values = {
            "harm_category": F.lit(harm_category), "mode": F.lit(mode), "provider": unless_failed(F.lit(self.provider)), "model": unless_failed(F.lit(self.model)),
            "cost_usd": cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(price_in), F.lit(price_out)),
        } | {c: unless_failed(F.col(c)) for c in ("label", "confidence", "key_signals", "reasoning")}
        return parsed.select(*id_cols, *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CLASSIFICATIONS])

    def classify(self, text: str, harm_category: str, mode: str = "zero_shot") -> dict:
        one = self.batch_classify(self.spark.createDataFrame([(text,)], "text string"), harm_category, mode)
        return one.first().asDict()


def compare_modes(zero_shot: DataFrame, few_shot: DataFrame, keys: list[str]) -> DataFrame:
    """Results of both modes for the same texts side by side: keys, label and confidence of each, and whether they agree. Texts that one mode failed on are left out."""
    side = lambda df, name: df.filter(F.col("label").isNotNull()).select(*keys, F.col("label").alias(f"{name}_label"), F.col("confidence").alias(f"{name}_confidence"))
    both = side(zero_shot, "zero_shot").join(side(few_shot, "few_shot"), keys)
    return both.withColumn("agree", F.col("zero_shot_label") == F.col("few_shot_label"))


def usage_summary(results: DataFrame) -> DataFrame:
    """Calls, tokens and cost per provider and model, from result rows."""
    done = results.filter(F.col("provider").isNotNull())
    return done.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd")).withColumn("cost_per_1k", ratio(F.col("cost_usd") * 1000, F.col("calls")))


def provider_cost(spark: SparkSession, scales: list[int], tokens_in: int = 450, tokens_out: int = 80, few_shot: float = 1.4, requests_per_minute: float = 50) -> DataFrame:
    """Cost and duration of labelling ``scales`` items with each provider."""
    prices = spark.createDataFrame([(p, DEFAULT_MODELS[p], *PRICES[p]) for p in PRICES], "provider string, model string, price_in double, price_out double")
    sizes = spark.createDataFrame([(n,) for n in scales], "n_items long")
    each = cost(F.lit(tokens_in), F.lit(tokens_out), F.col("price_in"), F.col("price_out"))
    return prices.crossJoin(F.broadcast(sizes)).select("provider", "model", "n_items", (F.col("n_items") * each).alias("cost_zero_shot"), (F.col("n_items") * each * few_shot).alias("cost_few_shot"), (F.col("n_items") / (requests_per_minute * 60)).alias("hours"))


CATEGORIES = HARM_VERTICALS
