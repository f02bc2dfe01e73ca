"""Operations for preparing language-model training text at scale; nothing else in the package imports them."""
