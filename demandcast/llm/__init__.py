"""Training-data operators over ``documents``: one module per operator."""
