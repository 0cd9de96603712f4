"""Remote services as data: a request is a row of expressions, a reply is read by an expression, and one transport sends.

Payloads are built and replies are read by JVM expressions, so both can be tested on recorded rows without a network.
Fixed values: addresses, payload names, limits on output and reply paths are those that the services ask for.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import Pace, overlapped

REPLY = "key string, status int, reply string, seconds double, attempts int, error string"


def _form(**fields: Column) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in fields.items()])


def _chat(model: Column, prompt: Column, temperature: Column, limit: Column | None = None) -> Column:
    """An OpenAI-style chat completion; no ``max_tokens`` without a limit, no temperature where it is null."""
    said = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    parts = [model.alias("model"), temperature.alias("temperature")]
    parts += [limit.alias("max_tokens")] if limit is not None else []
    return F.to_json(F.struct(*parts, said.alias("messages")))


def _long(text: Column) -> Column:
    """The room that a translation is given: six tokens a character and 4000 more."""
    return F.length(text) * 6 + 4000


@dataclass(frozen=True)
class Service:
    """One way to call a service. ``body`` gets the row's columns by name; ``path`` is where a reply has its text.

    Columns of a request row: model, prompt, text, temperature, thinking, source_code, target_code.
    """

    name: str
    url: str
    body: Callable[[Callable[[str], Column]], Column]
    path: str
    auth: str = "Authorization: Bearer {key}"
    as_json: bool = True
    codes: str | None = None  # the column of the language table that holds this service's codes
    error_path: str | None = None
    strip: bool = False


#: The services that translate; the prompt holds the instruction and the text.
TRANSLATORS = {
    s.name: s
    for s in (
        Service("openrouter", "https://openrouter.ai/api/v1/chat/completions",
                lambda c: _chat(c("model"), c("prompt"), c("temperature"), _long(c("text"))), "$.choices[0].message.content"),
        Service("anthropic", "https://api.anthropic.com/v1/messages",
                lambda c: _chat(c("model"), c("prompt"), c("temperature"), F.lit(1024)), "$.content[0].text", 
                auth="x-api-key: {key}\nanthropic-version: 2023-06-01"),
        Service("cohere", "https://api.cohere.com/v1/generate",
                lambda c: F.to_json(F.struct(c("model").alias("model"), c("prompt").alias("prompt"), _long(c("text")).alias("max_tokens"),
                                             c("temperature").alias("temperature"))), "$.generations[0].text", strip=True),
        Service("deepl", "https://api.deepl.com/v2/translate",
                lambda c: _form(
                    text=c("text"), source_lang=c("source_code"), target_lang=c("target_code"),
                ), "$.translations[0].text",
                auth="Authorization: DeepL-Auth-Key {key}", as_json=False, codes="deepl_code"),
        Service("google", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
                lambda c: _contents(
                    c("prompt"), c("temperature"), c("thinking"),
                ), "$.candidates[0].content.parts[0].text",
                auth="x-goog-api-key: {key}"),
        Service("groq", "https://api.groq.com/openai/v1/chat/completions",
                lambda c: _chat(c("model"), c("prompt"), c("temperature")), "$.choices[0].message.content"),
        Service("lingvanex", "https://api-b2b.backenster.com/b1/api/v3/translate/",
                lambda c: _form(
                    **{"from": c("source_code"), "to": c("target_code"), "text": c("text"), "platform": F.lit("dp")}
                ), "$.result",
                as_json=False, codes="lingvanex_code", error_path="$.err"),
        Service("mistral", "https://api.mistral.ai/v1/chat/completions",
                lambda c: _chat(c("model"), c("prompt"), c("temperature")), "$.choices[0].message.content"),
        Service("hybrid", "{model}",  # the address is the deployment's own
                lambda c: F.to_json(F.struct(c("source_code").alias("source_lang"), c("target_code").alias("target_lang"), c("text").alias("text"),
                                             F.lit("NormalFormality").alias("formality"), F.lit("{key}").alias("token"))), "combined", auth="",
                codes="hybrid_code"),
    )
}
#: The services that judge.
JUDGES = {
    s.name: s
    for s in (
        Service("openrouter", "https://openrouter.ai/api/v1/chat/completions",
                lambda c: _chat(c("model"), c("prompt"), c("temperature"), F.lit(9000)), "$.choices[0].message.content"),
        Service("google", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
                lambda c: _contents(
                    c("prompt"), c("temperature"), c("thinking"),
                ), "$.candidates[0].content.parts[0].text",
                auth="x-goog-api-key: {key}"),
    )
}


def _contents(prompt: Column, temperature: Column, thinking: Column) -> Column:
    """A generateContent body; without thinking its budget is 0, with it the service's own."""
    budget = F.when(~F.coalesce(thinking, F.lit(False)), F.struct(F.lit(0).alias("thinkingBudget")))
    said = F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts")))
    return F.to_json(
        F.struct(
            said.alias("contents"),
            F.struct(temperature.alias("temperature"), budget.alias("thinkingConfig")).alias("generationConfig"),
        )
    )


def requests(rows: DataFrame, service: Service, prefix: str = "") -> DataFrame:
    """``rows`` with url, header, kind and body of the call; ``prefix`` goes before the prompt.

    A language that the service has no code for leaves the body null: the row isn't sent.
    """
    rows = rows.withColumn("prompt", F.concat(F.lit(prefix), F.col("prompt"))) if prefix else rows
    known = F.col("source_code").isNotNull() & F.col("target_code").isNotNull() if service.codes else F.lit(True)
    kind = "application/json" if service.as_json else "application/x-www-form-urlencoded"
    return rows.withColumns({
        "url": F.replace(F.lit(service.url), F.lit("{model}"), F.col("model")), "header": F.lit(service.auth),
        "kind": F.lit(kind),
        "body": F.when(known, service.body(F.col)),
    })


def with_codes(rows: DataFrame, languages: DataFrame, service: Service) -> DataFrame:
    """``rows`` (source, target) with the service's codes of both languages; null where it has none."""
    if service.codes is None:
        return rows.withColumns({"source_code": F.col("source"), "target_code": F.col("target")})
    codes = languages.select("language", F.col(service.codes).alias("code"))
    for side in ("source", "target"):
        named = F.broadcast(codes.select(F.col("language").alias(side), F.col("code").alias(f"{side}_code")))
        rows = rows.join(named, side, "left")
    return rows


def answer(service: Service, status: Column, reply: Column) -> tuple[Column, Column]:
    """(text, error) of a reply: a status other than 200, a reported error or a missing text is an error."""
    if service.path == "combined":  # the first of several translations that is marked as the combined one
        listed = F.from_json(F.get_json_object(reply, "$.translations"), "array<struct<text:string,combined:boolean>>")
        text = F.try_element_at(F.filter(listed, lambda x: x["combined"]), F.lit(1))["text"]
    else:
        text = F.get_json_object(reply, service.path)
    text = F.regexp_replace(text, r"^\s+|\s+$", "") if service.strip else text
    said = F.get_json_object(reply, service.error_path) if service.error_path else F.lit(None).cast("string")
    said = F.when(~F.coalesce(said, F.lit("")).isin("", "null", "false"), said)
    failed = F.coalesce(status, F.lit(0)) != 200
    error = F.when(
        failed, F.concat(F.lit(f"{service.name}: status "), status.cast("string")),
    ).when(said.isNotNull(), said)
    error = F.coalesce(error, F.when(text.isNull(), F.lit(f"{service.name}: no text in the reply")))
    return F.when(error.isNull(), text), error


def post(url: str, headers: dict[str, str], body: str, timeout: float) -> tuple[int, str]:
    """Status and text of a POST."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers), timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def send(
    rows: DataFrame, key: Callable[[], str], attempts: int = 3, wait: float = 5.0, jitter: float = 2.0, timeout: float = 300.0, transport: Callable = post,
    at_once: int = 1, rate: float | None = None,
) -> DataFrame:
    """Send rows (key, url, header, kind, body): REPLY, one row each; a null body is not sent.

    ``key`` gives the credential inside the task. A call starts after a random wait of up to ``jitter`` seconds, and a
    failed one is tried again after a wait that grows with each attempt. ``at_once`` calls of a task overlap, and a task starts at most
    ``rate`` calls a second, repeated ones included; a service sees both times the tasks that run. Replies keep the order of the rows.
    """

    def run(batches):
        secret, pace = key(), Pace(rate)

        def one(url, header, kind, body):
            status, reply, error, began, tried = None, None, None, time.time(), 0
            if body is not None:
                time.sleep(random.uniform(0, jitter))
                headers = dict(line.split(": ", 1) for line in header.replace("{key}", secret).splitlines())
                body = body.replace('"{key}"', json.dumps(secret))
            for i in range(attempts if body is not None else 0):
                pace.wait()
                began, tried = time.time(), i + 1
                try:
                    status, reply = transport(url, headers | {"Content-Type": kind}, body, timeout)
                    error = None
                except Exception as e:  # a transport may raise anything
                    error = f"{type(e).__name__}: {e}"
                if status == 200:
                    break
                if i + 1 < attempts:
                    time.sleep(wait * (i + 1))
            return status, reply, time.time() - began, tried, error if body is not None else "not supported"

        for batch in batches:
            asked = zip(*(batch.column(c).to_pylist() for c in ("url", "header", "kind", "body")))
            out = list(overlapped(one, asked, at_once))
            types = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns], names=[f.split()[0] for f in REPLY.split(", ")]
            )

    return rows.select("key", "url", "header", "kind", "body").mapInArrow(run, REPLY)


def ask(rows: DataFrame, service: Service, key: Callable[[], str], prefix: str = "", **how) -> DataFrame:
    """(key, value, seconds, error) of request rows: built, sent and read."""
    replies = send(requests(rows, service, prefix), key, **how)
    text, error = answer(service, F.col("status"), F.col("reply"))
    return replies.select("key", text.alias("value"), "seconds", F.coalesce(F.col("error"), error).alias("error"))
