"""Operations for building training corpora at scale."""
