import pytest

WORDS = "river stone cloud under seven bright market garden winter letter moving silver corner thunder".split()


def prose(n, seed=0):
    """n different-looking words."""
    return " ".join(f"{WORDS[(i * 7 + seed) % 14]}{(i * i + 31 * seed) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use."""
    rows = [
        (1, prose(60), "a"), (1, prose(60), "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (None, prose(60), "b"),
        (5, prose(9000, 5), "b"), (6, "one", "b"), (7, prose(60, 3), None), (8, prose(61), "a"), (9, "x" * 5000, "c"), (9, prose(30, 9), "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clash = "row key name gram rep n component component_id held_out score copy shuffle_key stats bits ids failed kept _n _source doc start parts place cdf times rate w angle stats_ _s _g _slice _before".split()
    return df.selectExpr("*", "'en' as lang", "cast(null as bigint) as n_chars", *(f"cast(null as int) as `{c}`" for c in clash))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (7, None, 1), (8, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
