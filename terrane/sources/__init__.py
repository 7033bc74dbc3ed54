"""terrane.sources"""
