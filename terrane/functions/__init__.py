"""terrane.functions"""
