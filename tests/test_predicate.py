import random

import pytest
from pyspark.sql import functions as F

from cartolith.plans.compile import compile_program, predicate
from cartolith.plans.program import Compare, Condition, Literal, Near, ParseError, Path, Search, parse, parse_or_search

BAG = '{"foo":{"bar":1,"baz":10},"some":["a","b"],"value":1,"string":"Some name","yes":true,"no":false,"null":null,"big":18446744073638380036,"half":0.5,"zero":0,"empty":"","numeral":"5"}'


def p(*steps):
    return Path(steps)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (".foo", [p("foo")]),
        (".foo.bar", [p("foo", "bar")]),
        ('."foo"."bar"', [p("foo", "bar")]),
        ('."foo.bar"', [p("foo.bar")]),
        (".foo.[0]", [p("foo", 0)]),
        (".some.0", [p("some", 0)]),
        (".some.-1", [p("some", -1)]),
        (".", [p()]),
        ('.value == "bar"', [p("value"), Literal("bar"), Compare("==")]),
        (".value == 'bar\"baz'", [p("value"), Literal('bar"baz'), Compare("==")]),
        (".value != 1", [p("value"), Literal(1), Compare("!=")]),
        (".value >= 1.5", [p("value"), Literal(1.5), Compare(">=")]),
        (".a ==1", [p("a"), Literal(1), Compare("==")]),
        (".string =~ /some/i", [p("string"), Literal("/some/i"), Compare("=~")]),
        (".a or .b and .c", [p("a"), p("b"), Condition("or"), p("c"), Condition("and")]),
        (".foo and .bar not", [p("foo"), p("bar"), Condition("and"), Condition("not")]),
        (".foo == 'not'", [p("foo"), Literal("not"), Compare("==")]),
        (".a > 1 < 5", [p("a"), Literal(1), Literal("<"), Literal(5), Compare(">")]),
        (".a>1", [p("a>1")]),
        (".a >1", [p("a"), Literal(">1")]),
        ("near(10.0, 20.0, 1000)", [Near(10.0, 20.0, 1000.0)]),
        ("near(1,2,3)and .a", [Near(1, 2, 3), Literal("and"), p("a")]),
        ("Café and bar", [Literal("Café"), Literal("bar"), Condition("and")]),
        ("Route 66", [Search("Route")]),
        ("66", [Search("")]),
        (r"'it\'s'", [Search("it's")]),
        (".a  ", [p("a")]),
    ],
)
def test_parse(text, expected):
    assert parse(text) == expected


@pytest.mark.parametrize("text", [".foo[0]", "l'École", '"open', "near(1,2)", "near(1,2,3", ".a.[x]"])
def test_what_cannot_be_parsed_is_searched_for(text):
    with pytest.raises(ParseError):
        parse(text)
    assert parse_or_search(text) == [Search(text)]


EXPECTED = {
    ".foo": True, ".foo.bar": True, ".some.0": True, ".some.[0]": True, ".some.-1": True, ".some.2": False, ".some.-3": False, ".foo.x": False, '."foo.bar"': False, ".foo.0": False, ".some.a": False, ".": True,
    '.value == "bar"': False, ".value == 1": True, ".value == 1.0": True, ".value != 1": False, ".value > 1": False, ".value >= 1": True, ".value >= 0.5": True, ".value < 1": False, ".value <= 1": True, ".value <= 1.5": True,
    ".foo.baz == 10": True, ".x == 1": False, ".x != 1": False, '.string =~ "name$"': True, ".string =~ /[Ss]ome/": True, ".string =~ ^some": False, ".string =~ /^some/i": True, ".string =~ '('": False, ".value =~ 1": False,
    ".foo.bar == 1 and .value == 1": True, ".foo == 1 or .value == 1": True, ".foo not": False, ".foo.bar not": False, ".foo and .bar not": True, ".x or .y not": True, ".foo.x not": True, ".foo and .some not": False, ".foo or .bar not": False,
    ".x == 1 or .value == 1": False, ".yes": True, ".no": False, ".null": False, ".zero": True, ".empty": True, ".yes == true": False, ".yes == .yes": True, ".yes == .no": False, ".value == .half": False, ".half < .value": True,
    ".big == 18446744073638380036": True, ".big == 18446744073638380037": False, ".big == 18446744073638380036.0": True, ".big > 5": True, ".numeral == 5": False, ".numeral == '5'": False, ".some == .some": True, ".foo == .foo": True, ".foo == .some": False, ".string > 'Rome'": True, ".string > 1": False,
    "not .foo": False, ".a == not": False, ".foo .value": False, "name": True, "NAME": True, "me na": True, "Some name": True, "b": False, "": False, "Some 66": True, "near(1,2,3)": False, ".foo and": False,
}


def test_evaluate(spark):
    row = spark.range(1).select(F.parse_json(F.lit(BAG)).alias("properties"))
    columns = [predicate(t).alias(f"c{i}") for i, t in enumerate(EXPECTED)]
    got = dict(zip(EXPECTED, row.select(*columns).first()))
    assert got == EXPECTED


def test_strict_keeps_quoted_numerals(spark):
    row = spark.range(1).select(F.parse_json(F.lit(BAG)).alias("properties"))
    assert row.select(predicate(".numeral == '5'", strict=True)).first()[0] is True


def test_near(spark):
    row = spark.range(1).select(F.parse_json(F.lit("{}")).alias("properties"), F.struct(F.lit(8.0).alias("x"), F.lit(47.0).alias("y")).alias("c"))
    assert row.select(predicate("near(47.001,8,150)", centroid="c"), predicate("near(47.001,8,100)", centroid="c")).first()[:] == (True, False)


def evaluate(program, bag):
    """A plain stack machine, as the definition has it."""
    stack = []

    def truth(x):
        return x if isinstance(x, bool) else x is not None

    for n in program:
        if isinstance(n, Path):
            v = bag
            for s in n.steps:
                v = v.get(s) if isinstance(v, dict) and isinstance(s, str) else None
            stack.append(v)
        elif isinstance(n, Literal):
            stack.append(n.value)
        elif isinstance(n, Condition) and n.op == "not":
            if not stack:
                return False
            stack.append(not truth(stack.pop()))
        else:
            if len(stack) < 2:
                return False
            b, a = stack.pop(), stack.pop()
            if isinstance(n, Condition):
                stack.append(truth(a) and truth(b) if n.op == "and" else truth(a) or truth(b))
                continue
            if a is None or b is None:
                return False
            kinds = [bool if isinstance(x, bool) else str if isinstance(x, str) else float for x in (a, b)]
            same = kinds[0] == kinds[1]
            if n.op in ("==", "!="):
                stack.append((same and a == b) == (n.op == "=="))
            else:
                stack.append(same and kinds[0] is not bool and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[n.op] if same else False)
    return len(stack) == 1 and truth(stack[0])


def test_random_programs_agree_with_a_stack_machine(spark):
    rnd = random.Random(5)
    bags = [{k: rnd.choice([0, 1, 2.5, "a", "b", True, False]) for k in "abc" if rnd.random() < 0.7} for _ in range(12)]
    import json

    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bags)], "i int, t string").withColumn("properties", F.parse_json("t")).orderBy("i")
    programs = []
    while len(programs) < 60:
        program = []
        for _ in range(rnd.randint(1, 9)):
            program.append(rnd.choice([Path((rnd.choice("abc"),)), Path((rnd.choice("abc"),)), Literal(rnd.choice([1, 2.5, "a"])), Compare(rnd.choice(["==", "!=", ">", ">=", "<", "<="])), Condition(rnd.choice(["and", "or", "not"]))]))
        if any(evaluate(program, b) for b in bags) or len(programs) < 10:
            programs.append(program)
    got = rows.select(*(compile_program(x).alias(f"p{i}") for i, x in enumerate(programs))).collect()
    for bag, row in zip(bags, got):
        assert list(row) == [evaluate(x, bag) for x in programs]
