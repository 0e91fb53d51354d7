"""Where data comes from and goes to."""

from .files import read_matrix_csv, read_table, write_scores_csv, write_table  # noqa: F401
