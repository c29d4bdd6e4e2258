"""Where the vocabularies of public tokenizers lie; operators take the path as a parameter."""


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
