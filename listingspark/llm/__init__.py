"""Operations for training-data pipelines. Nothing outside this folder imports it but the registry's guarded import."""
