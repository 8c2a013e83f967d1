"""Whether a text is valid in its language: parsers of Python, JavaScript, C and C++."""
