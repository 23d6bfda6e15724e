"""A grid whose cells are finished one by one."""


def test_cells_of_a_grid_are_finished_one_by_one(spark, folder):
    """Before, the plans of all cells were kept and run as one."""
    from minutario.plans.documents import retrieval_grid

    cells = retrieval_grid(spark, folder, (600,), (0, 100), (1, 5), ("hybrid",))
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString() and cells.count() == 4
