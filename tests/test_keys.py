import random

from pyspark.sql import functions as F

from palimpsest.functions.canonical import plain
from palimpsest.functions.keys import plain_key


def test_keys_have_one_spelling_in_columns_and_in_python(spark):
    r = random.Random(3)
    texts = ["7", "7.0", " 7 ", "7e0", "+7", "007", "-0", "-0.0", "0.10", "1e2", "12345678901234567.0", "1e-13", "5e-13", "1e25", "1e26", "1e999", "1.", ".5", "abc", "A b ", "", "  ", "12345678901234567890123456789", "1E+3", "-12.340", "nan", "1_0", "٧"]
    texts += ["".join(r.choice("0123456789.eE+- x") for _ in range(r.randrange(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plain_key(F.col("t")).alias("k")).collect()
    assert {x.t: x.k for x in rows} == {t: plain(t) for t in texts}
    assert [plain(x) for x in (7, 7.5, 0.1, True, None, [1], {})] == ["7", "7.5", "0.1", "true", None, None, None]
