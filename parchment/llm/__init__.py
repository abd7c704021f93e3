"""Operations for large training-data pipelines. Nothing else in parchment imports this subpackage."""
