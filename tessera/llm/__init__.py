"""Operations of a training-data pipeline: one module an operator, ``queries`` for the registered queries."""
