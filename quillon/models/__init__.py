"""Trained models as columns, or as Arrow kernels where they are large."""
