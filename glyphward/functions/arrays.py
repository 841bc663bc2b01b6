"""Array expressions whose cost grows with the array's length alone, however they are nested.

What a lambda captures from outside is evaluated again for each element; bind() makes a value of it first. Appending to
an array copies it; running() therefore appends within blocks and joins the blocks at the end. Lambdas that need nothing
from outside are SQL texts: they are parsed at once, where each method of a Column is a call to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none(kind: str) -> Column:
    """An empty array of elements of that type."""
    return F.expr(f"cast(array() as array<{kind}>)")


def call(function: str, *arguments: Column | str) -> Column:
    """A function of columns and, as texts, SQL lambdas without free names."""
    return F.call_function(function, *[F.expr(a) if isinstance(a, str) else a for a in arguments])


def running(items: Column, state: str, after: str, element: str, kind: str) -> Column:
    """array<kind> of the elements along the items; empty for null items.

    state is the first state in SQL; after and element are the next state and the element of item x in state a.state.
    """
    step = f"named_struct('state', {after}, 'element', {element})"
    keep = f"element_at(transform(array({step}), v -> named_struct('state', v.state, 'out', concat(a.out, array(v.element)))), 1)"
    block = f"aggregate(slice(xs, b * {BLOCK} + 1, {BLOCK}), named_struct('state', acc.state, 'out', cast(array() as array<{kind}>)), (a, x) -> {keep})"
    join = f"element_at(transform(array({block}), w -> named_struct('state', w.state, 'out', concat(acc.out, array(w.out)))), 1)"
    blocks = f"if(size(xs) > 0, sequence(0, cast(floor((size(xs) - 1) / {BLOCK}) as int)), cast(array() as array<int>))"
    whole = f"xs -> flatten(aggregate({blocks}, named_struct('state', {state}, 'out', cast(array() as array<array<{kind}>>)), (acc, b) -> {join}).out)"
    return F.element_at(call("transform", F.array(items), whole), 1)


def rows_of(df: DataFrame, structs: Column | str, mark: str, *keys: Column | str) -> DataFrame:
    """The keys and the fields of each struct of an array, a row each; field mark is null in none of them.

    A plain inline() would have the optimizer test the array's size first, which evaluates all that makes the array
    twice, with its own parts put in wherever they are used.
    """
    return df.select(*keys, F.inline_outer(structs)).filter(F.col(mark).isNotNull())
