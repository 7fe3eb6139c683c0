"""Stage-one features, ordered windows and keyed folds."""
