"""functions of the engine; each module says what it holds."""
