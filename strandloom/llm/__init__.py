"""Training-data operators: each module is one operator with its own general interface."""
