"""Operations of a training-data pipeline. Nothing else in quarry imports this subpackage."""
