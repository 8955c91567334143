"""Training-data operators: each module is one operator with a general
interface; ``queries`` registers the thin query of each."""
