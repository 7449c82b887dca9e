"""Domain operators: what linking disturbance events to environmental series is made of."""
