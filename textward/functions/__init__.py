"""textward.functions"""
