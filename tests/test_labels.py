"""Names of plants."""

import pytest

from fieldspark.operators import labels


@pytest.mark.parametrize("how", ["ridge", "numeric"])
@pytest.mark.parametrize("ascending", [True, False])
def test_noise_of_a_projection_does_not_order_plants(spark, how, ascending):
    rows = [(0, 1, 0, 0.1 + 0.2), (0, 2, 0, 0.3), (0, 3, 0, 0.30000000000000016), (0, 4, 0, 0.2999)]  # the first three are side by side
    df = spark.createDataFrame(rows, "field_id long, fid long, ridge_id int, along double")
    found = {r["fid"]: r["plant_id"] for r in labels.plant_ids(df, how, ascending=ascending, digits=6).collect()}
    order = [4, 1, 2, 3] if ascending else [1, 2, 3, 4]
    assert found == {fid: f"1-{k}" if how == "ridge" else str(k) for k, fid in enumerate(order, 1)}
