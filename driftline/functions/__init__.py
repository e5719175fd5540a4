"""Function registries of the two query languages."""
