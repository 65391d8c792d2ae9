"""Operators for large-scale training-data pipelines (see README, section "Training-data operators")."""
