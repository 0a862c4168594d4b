"""Tool calls of a response as columns: default requests, argument parsing, ordered scoring rules, configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_value_is(arguments: Column, wanted: Column) -> Column:
    """Whether a string among the values of a JSON object (variant) equals ``wanted``, whatever the case."""
    values = F.map_values(F.try_variant_get(arguments, "$", "map<string,variant>"))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.exists(values, lambda v: F.coalesce(F.lower(text(v)) == F.lower(wanted), F.lit(False)))


def first_call(calls: Column, execute: Column, verify: Column, wanted: Column, field: Column) -> Column:
    """struct(score, first_tool, n_calls, parse_error) of a response's calls, array<struct<name, arguments>>.

    ``arguments`` is a JSON text. Just one call may be made; it must be ``execute`` with a value that is ``wanted``
    (EXECUTE) or ``verify`` of ``field`` (VERIFY). All else is UNPARSED, with the first reason that holds.
    """
    n = F.coalesce(F.size(calls), F.lit(0))
    first = F.try_element_at(calls, F.lit(1))
    name, arguments = first["name"], F.try_parse_json(first["arguments"])
    is_object = F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT"))
    is_text = F.startswith(F.schema_of_variant(F.try_variant_get(arguments, "$.field", "variant")), F.lit("STRING"))
    asked = F.when(is_text, F.try_variant_get(arguments, "$.field", "string"))
    lacking = F.greatest(*[F.coalesce(x, F.lit("")) == "" for x in (execute, verify, wanted, field)])
    error = (
        F.when(n == 0, "no_tool_call")
        .when(n > 1, "multiple_tool_calls")
        .when(arguments.isNull(), "malformed_arguments")
        .when(~is_object, "arguments_not_object")
        .when(lacking, "item_missing_scoring_fields")
        .when(name == execute, F.when(~any_value_is(arguments, wanted), "execute_missing_or_invented_value"))
        .when(name == verify, F.when(~F.coalesce(asked == field, F.lit(False)), "verify_wrong_field"))
        .otherwise("unexpected_tool")
    )
    score = F.when(error.isNotNull(), "UNPARSED").when(name == execute, "EXECUTE").otherwise("VERIFY")
    return F.struct(score.alias("score"), name.alias("first_tool"), n.alias("n_calls"), error.alias("parse_error"))


def with_defaults(
    messages: Column, tools: Column, prompt: Column, execute: Column, verify: Column,
) -> tuple[Column, Column]:
    """``messages`` and ``tools``, made from the prompt and the two names where they are null."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.coalesce(messages, F.array(message)), F.coalesce(tools, F.array(execute, verify))


def configuration(
    explicit: list[Column], model: Column, provider: Column, configs: dict[str, tuple[str, str]],
) -> Column:
    """struct(id, problem): the configuration that a record names, or the only one of its model and provider.

    ``explicit``: where the name may stand, the first that is not null counts. ``configs``: id to (model, provider), a
    frozen list.
    """
    named = F.coalesce(*explicit)
    known = F.create_map(
        *[
            x
            for k, (m, p) in configs.items()
            for x in (F.lit(k), F.struct(F.lit(m).alias("model"), F.lit(p).alias("provider")))
        ]
    )
    own = F.try_element_at(known, named)
    fits = F.array_compact(
        F.array(*[F.when((model == m) & (provider == p), F.lit(k)) for k, (m, p) in configs.items()])
    )
    found = F.when(named.isNotNull(), F.when(own.isNotNull(), named)).when(F.size(fits) == 1, F.element_at(fits, 1))
    same = model.eqNullSafe(own["model"]) & provider.eqNullSafe(own["provider"])
    problem = (
        F.when(named.isNotNull() & own.isNull(), "unknown configuration")
        .when(named.isNotNull() & ~same, "other model or provider")
        .when(named.isNull() & (F.size(fits) != 1), "not identified")
    )
    return F.struct(found.alias("id"), problem.alias("problem"))
