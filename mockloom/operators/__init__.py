"""DataFrame operators: catalogues, generation, fidelity, privacy, job reports."""
