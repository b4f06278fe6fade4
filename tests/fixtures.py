"""Small relational fixtures."""

# Rows and column names of small tables that results must be equal on.
R = ("a int, b int, d int, h double", [(1, 1, 1, 1.0), (2, 1, 2, 3.0), (1, 2, 1, 1.0), (2, 2, 2, 2.0), (2, 3, 4, 6.0)])
ONE_TO_MANY = {
    "R": R,
    "S": ("f int, e int", [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4)]),
    "T": ("b int, f int, k int", [(1, 3, 100), (2, 2, 100), (3, 1, 300)]),
}
MANY_TO_MANY = {
    "R": R,
    "S": ("b int, e int", [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4)]),
    "T": ("b int, f int", [(1, 2), (2, 2), (3, 1), (1, 3)]),
}


def frames(spark, found):
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in found.items()}
