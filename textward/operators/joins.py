"""Tokens, their store and their restoration; replies put together from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions import text as T

TOKEN = r"\[TW_PII_[A-Za-z0-9_-]{22}\]"


def redactions(df: DataFrame, scope: str, values: str, key: bytes) -> DataFrame:
    """(scope_id, token, value) of an array column of values, each once for a scope."""
    rows = df.select(F.sha2(F.col(scope).cast("string"), 256).alias("scope_id"), F.explode(values).alias("value")).distinct()
    return rows.select("scope_id", T.token(key, F.col("value")).alias("token"), "value")


def restore(df: DataFrame, store: DataFrame, key: str, scope: str, text: str, authorized: DataFrame | None = None) -> DataFrame:
    """(key, restored): every token of the scope's store, and of `authorized` (scope_id, token) if given, replaced by its value; others stay.

    Only rows with a token are shuffled, by scope and token, and back by key.
    """
    rows = df.select(F.col(key).alias("k"), F.sha2(F.col(scope).cast("string"), 256).alias("scope_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    known = store if authorized is None else store.join(authorized, ["scope_id", "token"], "left_semi")
    held = rows.where(F.contains("t", F.lit("[TW_")) & F.col("t").rlike(TOKEN))
    parts = held.select("k", "scope_id", F.posexplode(F.arrays_zip(F.split("t", TOKEN, -1).alias("gap"), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("token"))).alias("n", "x"))
    joined = parts.select("k", "scope_id", "n", "x.gap", "x.token").join(known, ["scope_id", "token"], "left")
    piece = F.concat("gap", F.coalesce("value", "token", F.lit("")))
    done = joined.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))), lambda x: x["p"]), "").alias("restored"))
    free = rows.where(~(F.contains("t", F.lit("[TW_")) & F.col("t").rlike(TOKEN))).select("k", F.col("t").alias("restored"))
    return free.unionByName(done).withColumnRenamed("k", key)


def attach_store(df: DataFrame, store: DataFrame, key: str, scope: str, texts: list[str], out: str = "store") -> DataFrame:
    """`df` with the entries (token, value) of its conversation that one of its texts names; only rows with a token are shuffled.

    `key` is unique. A check that restores reads them by `store=`.
    """
    said = F.concat_ws(" ", *(F.col(t).cast("string") for t in texts))
    rows = df.select(F.col(key).alias("k"), F.sha2(F.col(scope).cast("string"), 256).alias("scope_id"), F.array_distinct(F.regexp_extract_all(said, F.lit(TOKEN), F.lit(0))).alias("ts"))
    named = rows.where(F.size("ts") > 0).select("k", "scope_id", F.explode("ts").alias("token")).join(store, ["scope_id", "token"])
    entries = named.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("token", "value"))).alias(out)).withColumnRenamed("k", f"{out}_k")
    keep = [c for c in df.columns if c != out]
    joined = df.select(*keep).join(entries, F.col(key) == F.col(f"{out}_k"), "left")
    return joined.select(*keep, F.coalesce(F.col(out), F.array().cast("array<struct<token:string,value:string>>")).alias(out))


def committed(store: DataFrame, checked: DataFrame, scope: str) -> DataFrame:
    """The store with the entries that allowed and complete checks staged, each once for a scope."""
    new = checked.where("ok").select(F.sha2(F.col(scope).cast("string"), 256).alias("scope_id"), F.explode("staged").alias("e")).select("scope_id", "e.token", "e.value").distinct()
    return store.select("scope_id", "token", "value").unionByName(new.join(store, ["scope_id", "token"], "left_anti"))


def one_scope(df: DataFrame, key: str, scopes: list[str]) -> DataFrame:
    """`df`, whose rows must name one conversation in all of `scopes`; another is an error."""
    same = F.size(F.array_distinct(F.array_compact(F.array(*(F.col(c).cast("string") for c in scopes))))) <= 1
    return df.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("a check names several conversations")).cast("boolean")))


def dumped(store: DataFrame, key: bytes) -> DataFrame:
    """(scope_id, sealed): each entry of a store encrypted by AES-GCM, bound to its scope and token, with a nonce made of them.

    A nonce stands for one scope, token and value, as the token is a keyed hash of the value.
    """
    nonce = F.unhex(F.substring(T.hmac_sha256(key, F.concat_ws("|", "scope_id", "token", "value")), 1, 24))
    sealed = F.aes_encrypt(F.col("value").cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat_ws("|", "scope_id", "token").cast("binary"))
    return store.select("scope_id", "token", F.base64(sealed).alias("sealed"))


def loaded(sealed: DataFrame, key: bytes, token_key: bytes | None = None) -> DataFrame:
    """The store of a dump. A changed entry, another key or another scope is an error; with `token_key` every token is derived again as well."""
    value = F.aes_decrypt(F.unbase64("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("|", "scope_id", "token").cast("binary")).cast("string")
    out = sealed.select("scope_id", "token", value.alias("value"))
    if token_key is None:
        return out
    good = T.token(token_key, F.col("value")) == F.col("token")
    return out.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a token is not of its value")).cast("boolean")))


def outside(calls: DataFrame, allowed: DataFrame, tool: str = "tool") -> DataFrame:
    """The calls of tools that are not in the table `allowed` (tool), null names among them; for lists too long for a policy."""
    known = allowed.select(F.col("tool").alias("__allowed")).distinct()
    return calls.join(known, F.col(tool) == F.col("__allowed"), "left_anti")


def with_context(df: DataFrame, key: str, prompts: DataFrame | None = None, sources: DataFrame | None = None, turns: DataFrame | None = None) -> DataFrame:
    """`df` with prompt, sources and history from tables (key, prompt), (key, n, source) and (key, turn, role, text); a check's context is some thousand values at most."""
    out = df
    if prompts is not None:
        out = out.join(prompts.select(key, "prompt"), key, "left")
    if sources is not None:
        out = out.join(sources.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"]).alias("sources")), key, "left")
    if turns is not None:
        history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        out = out.join(turns.groupBy(key).agg(history.alias("history")), key, "left")
    return out


def violations(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of every term of a table that a text has and whose first word is a word of the text, in either case.

    Terms are met by that word, so no text is compared with all of them. `terms` has
    (term), each beginning with a letter or digit.
    """
    first = lambda c: F.regexp_extract(F.lower(c), r"(?U)\A(\w+)", 1)
    listed = terms.select("term", first(F.col("term")).alias("w")).distinct()
    words = texts.select(key, F.col(text).alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))).alias("w"))
    met = words.drop("t").join(listed, "w").select(key, "term").distinct()
    return met.join(texts.select(key, F.col(text).alias("t")), key).where(F.contains(F.lower("t"), F.lower("term"))).select(key, "term")


def assembled(parts: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The parts of each reply joined in order; a reply's parts are few."""
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("reply"), F.count("*").alias("parts"))
