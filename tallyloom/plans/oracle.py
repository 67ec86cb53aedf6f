"""Plain SQL for every named query, written apart from the Spark code and run by DuckDB as a check."""

from __future__ import annotations

# Building blocks in dependency order; a block that a query does not use is not evaluated.
BLOCKS = {
    # stock ledger from order lines and parts
    "m": """
SELECT CAST(l.l_shipdate AS DATE) AS d, 'S00' || CAST(l.l_suppkey % 4 AS STRING) AS store_id,
       p.p_name AS product_name,
       SUM(CASE WHEN l.l_returnflag = 'R'
                THEN CAST(FLOOR(l.l_quantity * (LENGTH(p.p_name) % 4) / 10) AS DOUBLE)
                ELSE CAST(0 AS DOUBLE) END) AS wasted,
       SUM(l.l_quantity) AS moved, MAX(p.p_retailprice) AS unit_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3""",
    "r": """
SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY store_id, product_name ORDER BY d) - 1) / 5) AS BIGINT) AS blk,
       CAST(((LENGTH(product_name) * 3 + ASCII(product_name)) % 8) * 60 AS DOUBLE) AS base FROM m""",
    "w": """
SELECT *, SUM(moved) OVER (PARTITION BY store_id, product_name, blk) AS tot,
       SUM(moved) OVER (PARTITION BY store_id, product_name, blk ORDER BY d
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
       ROW_NUMBER() OVER (PARTITION BY store_id, product_name, blk ORDER BY d) AS rb FROM r""",
    "inv": """
SELECT d AS date, store_id, REPLACE(product_name, ' ', '_') AS product_id, product_name,
       SPLIT_PART(product_name, ' ', 2) AS category,
       base + CASE WHEN rb = 1 THEN CAST(0 AS DOUBLE) ELSE tot - run + moved END AS opening_stock,
       CASE WHEN rb = 1 THEN tot ELSE CAST(0 AS DOUBLE) END AS purchased_quantity,
       moved - wasted AS sold_quantity, wasted AS wasted_quantity, base + tot - run AS closing_stock, unit_price
FROM w""",
    # the same as text with defects, and read back
    "dirty": """
SELECT CASE WHEN dd = 3 THEN 'not-a-date' ELSE CAST(date AS VARCHAR) END AS date, store_id, product_id,
       CASE WHEN dd = 9 THEN '  ' ELSE product_name END AS product_name, category,
       CAST(opening_stock AS VARCHAR) AS opening_stock, CAST(purchased_quantity AS VARCHAR) AS purchased_quantity,
       CASE WHEN dd = 5 AND store_id = 'S001' THEN 'abc'
            WHEN dd = 13 AND store_id = 'S003' THEN CAST(opening_stock + purchased_quantity + 1 AS VARCHAR)
            ELSE CAST(sold_quantity AS VARCHAR) END AS sold_quantity,
       CASE WHEN dd = 7 AND store_id = 'S002' THEN '-1.0' ELSE CAST(wasted_quantity AS VARCHAR) END AS wasted_quantity,
       CASE WHEN dd = 11 THEN CAST(closing_stock + 1 AS VARCHAR) ELSE CAST(closing_stock AS VARCHAR) END
         AS closing_stock,
       CAST(unit_price AS VARCHAR) AS unit_price
FROM (SELECT *, EXTRACT(DAY FROM date) AS dd FROM inv) x
JOIN (VALUES (1), (2)) AS c(k) ON k = 1 OR (dd = 1 AND store_id = 'S000')""",
    "typed": """
SELECT TRY_CAST(date AS DATE) AS date, store_id, product_id, product_name, category,
       TRY_CAST(opening_stock AS DOUBLE) AS opening_stock, TRY_CAST(purchased_quantity AS DOUBLE) AS purchased_quantity,
       TRY_CAST(sold_quantity AS DOUBLE) AS sold_quantity, TRY_CAST(wasted_quantity AS DOUBLE) AS wasted_quantity,
       TRY_CAST(closing_stock AS DOUBLE) AS closing_stock, TRY_CAST(unit_price AS DOUBLE) AS unit_price
FROM dirty""",
    "coerced": """
SELECT COUNT(*) FILTER (date IS NULL) AS bad_date, COUNT(*) FILTER (opening_stock IS NULL) AS bad_opening_stock,
       COUNT(*) FILTER (purchased_quantity IS NULL) AS bad_purchased_quantity,
       COUNT(*) FILTER (sold_quantity IS NULL) AS bad_sold_quantity,
       COUNT(*) FILTER (wasted_quantity IS NULL) AS bad_wasted_quantity,
       COUNT(*) FILTER (closing_stock IS NULL) AS bad_closing_stock,
       COUNT(*) FILTER (unit_price IS NULL) AS bad_unit_price FROM typed""",
    "counted": """
SELECT COUNT(*) * 11 - COUNT(date) - COUNT(store_id) - COUNT(product_id) - COUNT(product_name) - COUNT(category)
         - COUNT(opening_stock) - COUNT(purchased_quantity) - COUNT(sold_quantity) - COUNT(wasted_quantity)
         - COUNT(closing_stock) - COUNT(unit_price) AS missing_cells,
       COUNT(*) FILTER (opening_stock < 0) AS negative_opening_stock,
       COUNT(*) FILTER (purchased_quantity < 0) AS negative_purchased_quantity,
       COUNT(*) FILTER (sold_quantity < 0) AS negative_sold_quantity,
       COUNT(*) FILTER (wasted_quantity < 0) AS negative_wasted_quantity,
       COUNT(*) FILTER (closing_stock < 0) AS negative_closing_stock,
       COUNT(*) FILTER (TRIM(product_name) = '') AS empty_names,
       COUNT(*) FILTER (NOT COALESCE(ROUND(opening_stock + purchased_quantity - sold_quantity - wasted_quantity, 2)
                                     = ROUND(closing_stock, 2), FALSE)) AS equation_breaks,
       COUNT(*) FILTER (sold_quantity > opening_stock + purchased_quantity) AS impossible_sales,
       COUNT(*) FILTER (wasted_quantity / NULLIF(purchased_quantity, 0) > 0.25) AS high_waste_rows FROM typed""",
    "outliers": """
SELECT COUNT(*) AS sales_outliers
FROM typed, (SELECT AVG(sold_quantity) AS mu, STDDEV_SAMP(sold_quantity) AS sd FROM typed) s
WHERE sd > 0 AND sold_quantity > mu + 3 * sd""",
    "copies": """
SELECT (SELECT COUNT(*) FROM dirty) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty) x) AS duplicate_rows""",
    "report": """
SELECT errors = '' AS is_valid, CAST(GREATEST(0, 100 - lost) AS BIGINT) AS data_quality_score, errors, warnings,
       (SELECT COUNT(*) FROM dirty) AS row_count, 'date' || CHR(10) || 'store_id' || CHR(10) || 'product_id' || CHR(10)
         || 'product_name' || CHR(10) || 'category' || CHR(10) || 'opening_stock' || CHR(10) || 'purchased_quantity'
         || CHR(10) || 'sold_quantity' || CHR(10) || 'wasted_quantity' || CHR(10) || 'closing_stock' || CHR(10)
         || 'unit_price' AS columns
FROM (
  SELECT CONCAT_WS(CHR(10),
      CASE WHEN bad_date > 0 THEN 'Found ' || bad_date || ' rows with invalid dates.' END,
      CASE WHEN bad_opening_stock > 0 THEN 'Column ''opening_stock'' has ' || bad_opening_stock
        || ' invalid numeric values.' END,
      CASE WHEN bad_purchased_quantity > 0 THEN 'Column ''purchased_quantity'' has ' || bad_purchased_quantity
        || ' invalid numeric values.' END,
      CASE WHEN bad_sold_quantity > 0 THEN 'Column ''sold_quantity'' has ' || bad_sold_quantity
        || ' invalid numeric values.' END,
      CASE WHEN bad_wasted_quantity > 0 THEN 'Column ''wasted_quantity'' has ' || bad_wasted_quantity
        || ' invalid numeric values.' END,
      CASE WHEN bad_closing_stock > 0 THEN 'Column ''closing_stock'' has ' || bad_closing_stock
        || ' invalid numeric values.' END,
      CASE WHEN bad_unit_price > 0 THEN 'Column ''unit_price'' has ' || bad_unit_price
        || ' invalid numeric values.' END,
      CASE WHEN missing_cells > 0 THEN 'Found ' || missing_cells || ' missing values in required columns.' END,
      CASE WHEN negative_opening_stock > 0 THEN 'Column ''opening_stock'' has ' || negative_opening_stock
        || ' negative values.' END,
      CASE WHEN negative_purchased_quantity > 0 THEN 'Column ''purchased_quantity'' has '
        || negative_purchased_quantity || ' negative values.' END,
      CASE WHEN negative_sold_quantity > 0 THEN 'Column ''sold_quantity'' has ' || negative_sold_quantity
        || ' negative values.' END,
      CASE WHEN negative_wasted_quantity > 0 THEN 'Column ''wasted_quantity'' has ' || negative_wasted_quantity
        || ' negative values.' END,
      CASE WHEN negative_closing_stock > 0 THEN 'Column ''closing_stock'' has ' || negative_closing_stock
        || ' negative values.' END,
      CASE WHEN empty_names > 0 THEN 'Found ' || empty_names || ' rows with empty product names.' END,
      CASE WHEN equation_breaks > 0 THEN 'Found ' || equation_breaks
        || ' rows where closing stock does not match inventory equation.' END,
      CASE WHEN impossible_sales > 0 THEN 'Found ' || impossible_sales
        || ' rows where sold quantity is greater than available stock.' END) AS errors,
    CONCAT_WS(CHR(10),
      CASE WHEN duplicate_rows > 0 THEN 'Found ' || duplicate_rows || ' duplicate rows.' END,
      CASE WHEN high_waste_rows > 0 THEN 'Found ' || high_waste_rows || ' rows with wastage rate above 25%.' END,
      CASE WHEN sales_outliers > 0 THEN 'Found ' || sales_outliers || ' possible sales outliers.' END) AS warnings,
    LEAST(10, duplicate_rows) + LEAST(15, 2 * bad_date) + LEAST(10, 2 * bad_opening_stock)
      + LEAST(10, 2 * bad_purchased_quantity) + LEAST(10, 2 * bad_sold_quantity) + LEAST(10, 2 * bad_wasted_quantity)
      + LEAST(10, 2 * bad_closing_stock) + LEAST(10, 2 * bad_unit_price) + LEAST(20, missing_cells)
      + LEAST(15, 2 * negative_opening_stock) + LEAST(15, 2 * negative_purchased_quantity)
      + LEAST(15, 2 * negative_sold_quantity) + LEAST(15, 2 * negative_wasted_quantity)
      + LEAST(15, 2 * negative_closing_stock) + LEAST(10, 2 * empty_names) + LEAST(25, equation_breaks)
      + LEAST(20, 2 * impossible_sales) + LEAST(10, high_waste_rows) + LEAST(10, sales_outliers) AS lost
  FROM coerced, counted, outliers, copies) x""",
    # KPIs
    "enr": """
SELECT *, opening_stock + purchased_quantity AS available_stock, sold_quantity * unit_price AS revenue,
       wasted_quantity * unit_price AS waste_value, closing_stock * unit_price AS closing_inventory_value,
       (opening_stock + closing_stock) / 2 AS average_inventory,
       COALESCE(sold_quantity / NULLIF(opening_stock + purchased_quantity, 0), 0) AS sell_through_rate,
       COALESCE(wasted_quantity / NULLIF(sold_quantity + wasted_quantity, 0), 0) AS waste_rate,
       COALESCE(sold_quantity / NULLIF((opening_stock + closing_stock) / 2, 0), 0) AS stock_turnover
FROM inv""",
    "snap": """
SELECT * EXCLUDE (rn) FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn FROM enr) x
WHERE rn = 1""",
    "stock": """
SELECT product_id, product_name, category, SUM(closing_stock) AS current_stock FROM snap GROUP BY 1, 2, 3""",
    "tot": """
SELECT product_id, product_name, category,
       CAST(SUM(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) AS total_revenue,
       SUM(sold_quantity) AS total_units_sold, SUM(wasted_quantity) AS total_units_wasted,
       CAST(SUM(CAST(waste_value AS DECIMAL(18, 2))) AS DOUBLE) AS total_waste_value,
       SUM(available_stock) AS total_available_stock, SUM(average_inventory) / COUNT(*) AS average_inventory,
       CAST(SUM(CAST(unit_price AS DECIMAL(18, 2))) AS DOUBLE) / COUNT(*) AS avg_unit_price,
       COUNT(DISTINCT date) AS active_days
FROM enr GROUP BY 1, 2, 3""",
    "rated": """
SELECT tot.*, current_stock, COALESCE(total_units_sold / NULLIF(total_available_stock, 0), 0) AS sell_through_rate,
       COALESCE(total_units_wasted / NULLIF(total_units_sold + total_units_wasted, 0), 0) AS waste_rate,
       COALESCE(total_units_sold / NULLIF(average_inventory, 0), 0) AS stock_turnover,
       COALESCE(total_units_sold / NULLIF(active_days, 0), 0) AS avg_daily_demand
FROM tot LEFT JOIN stock USING (product_id, product_name, category)""",
    "covered": """
SELECT *, CASE WHEN avg_daily_demand > 0 THEN current_stock / avg_daily_demand ELSE CAST('inf' AS DOUBLE) END
            AS days_of_stock_left FROM rated""",
    "classed": """
SELECT *, CASE WHEN days_of_stock_left <= 7 THEN 'High' WHEN days_of_stock_left <= 14 THEN 'Medium' ELSE 'Low' END
            AS stockout_risk,
       CASE WHEN avg_daily_demand = 0 AND current_stock > 0 THEN 'High' WHEN days_of_stock_left > 45 THEN 'High'
            WHEN days_of_stock_left > 30 THEN 'Medium' ELSE 'Low' END AS overstock_risk
FROM covered""",
    "perf": """
SELECT *, CAST(GREATEST(0, 100
         - CASE stockout_risk WHEN 'High' THEN 25 WHEN 'Medium' THEN 12 ELSE 0 END
         - CASE overstock_risk WHEN 'High' THEN 20 WHEN 'Medium' THEN 10 ELSE 0 END
         - CASE WHEN waste_rate > 0.10 THEN 15 WHEN waste_rate > 0.05 THEN 7 ELSE 0 END
         - CASE WHEN sell_through_rate < 0.20 THEN 10 ELSE 0 END) AS BIGINT) AS product_health_score
FROM classed""",
    "cat": """
SELECT category, total_revenue, total_units_sold, total_units_wasted, total_waste_value, total_available_stock,
       product_count, COALESCE(total_units_sold / NULLIF(total_available_stock, 0), 0) AS sell_through_rate,
       COALESCE(total_units_wasted / NULLIF(total_units_sold + total_units_wasted, 0), 0) AS waste_rate
FROM (SELECT category, CAST(SUM(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) AS total_revenue,
             SUM(sold_quantity) AS total_units_sold, SUM(wasted_quantity) AS total_units_wasted,
             CAST(SUM(CAST(waste_value AS DECIMAL(18, 2))) AS DOUBLE) AS total_waste_value,
             SUM(available_stock) AS total_available_stock, COUNT(DISTINCT product_id) AS product_count
      FROM enr GROUP BY 1) x""",
    "risk": """
SELECT COUNT(*) FILTER (stockout_risk = 'High') AS high_stockout_risk_products,
       COUNT(*) FILTER (stockout_risk = 'Medium') AS medium_stockout_risk_products,
       COUNT(*) FILTER (overstock_risk = 'High') AS high_overstock_risk_products,
       COUNT(*) FILTER (overstock_risk = 'Medium') AS medium_overstock_risk_products,
       COUNT(*) FILTER (waste_rate > 0.10) AS high_waste_products FROM perf""",
    "base_summary": """
SELECT CAST(MIN(date) AS VARCHAR) AS date_start, CAST(MAX(date) AS VARCHAR) AS date_end,
       COUNT(DISTINCT store_id) AS unique_stores, COUNT(DISTINCT product_id) AS unique_products,
       ROUND(CAST(SUM(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_revenue,
       CAST(SUM(sold_quantity) AS BIGINT) AS total_units_sold,
       CAST(SUM(wasted_quantity) AS BIGINT) AS total_units_wasted,
       ROUND(CAST(SUM(CAST(waste_value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_waste_value,
       (SELECT ROUND(CAST(SUM(CAST(closing_inventory_value AS DECIMAL(18, 2))) AS DOUBLE), 2) FROM snap)
         AS latest_inventory_value,
       ROUND(SUM(sold_quantity) / SUM(available_stock), 4) AS average_sell_through_rate,
       ROUND(SUM(wasted_quantity) / (SUM(sold_quantity) + SUM(wasted_quantity)), 4) AS average_waste_rate
FROM enr""",
    "summ": """
SELECT b.*, CAST(GREATEST(0, LEAST(100, 100
         - CASE WHEN average_sell_through_rate < 0.30 THEN 15 WHEN average_sell_through_rate < 0.50 THEN 8 ELSE 0 END
         - LEAST(TRUNC(average_waste_rate * 200), 25)
         - TRUNC(high_stockout_risk_products / GREATEST(unique_products, 1) * 25)
         - TRUNC(high_overstock_risk_products / GREATEST(unique_products, 1) * 20)
         - TRUNC(high_waste_products / GREATEST(unique_products, 1) * 15))) AS BIGINT) AS inventory_health_score
FROM base_summary b, risk""",
    # demand and forecast
    "daily": """
SELECT date, product_id, product_name, category, SUM(sold_quantity) AS sold_quantity FROM inv GROUP BY 1, 2, 3, 4""",
    "span": "SELECT product_id, MIN(date) AS lo, MAX(date) AS hi FROM daily GROUP BY 1",
    "spine": """
SELECT product_id, CAST(UNNEST(GENERATE_SERIES(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span""",
    "dense": """
SELECT s.date, s.product_id, f.product_name, f.category, COALESCE(d.sold_quantity, 0) AS sold_quantity
FROM spine s LEFT JOIN daily d ON d.product_id = s.product_id AND d.date = s.date
JOIN (SELECT product_id, ARG_MIN(product_name, date) AS product_name, ARG_MIN(category, date) AS category
      FROM daily GROUP BY 1) f ON f.product_id = s.product_id""",
    "placed": """
SELECT x.*, DATE_DIFF('day', lo, date) AS idx, DATE_DIFF('day', lo, hi) + 1 AS n
FROM dense x JOIN span USING (product_id)""",
    "win": """
SELECT product_id, product_name, category, MAX(n) AS history_days, AVG(sold_quantity) AS avg_daily_demand,
       AVG(sold_quantity) FILTER (idx >= n - LEAST(n, 14)) AS recent_avg_daily_demand,
       AVG(sold_quantity) FILTER (idx >= n - LEAST(n, 28) AND idx < n - LEAST(n, 28) + 14) AS previous_avg_daily_demand,
       STDDEV_POP(sold_quantity) AS demand_std
FROM placed GROUP BY 1, 2, 3""",
    "known": """
SELECT win.*, CAST(TRUNC(COALESCE(p.current_stock, 0)) AS BIGINT) AS stock,
       COALESCE((recent_avg_daily_demand - previous_avg_daily_demand) / NULLIF(previous_avg_daily_demand, 0), 0) AS tr
FROM win LEFT JOIN
  (SELECT product_id, ARG_MAX(current_stock, total_revenue) AS current_stock FROM perf GROUP BY 1) p USING (product_id)""",
    "sized": """
SELECT *, CAST(ROUND_EVEN(GREATEST(recent_avg_daily_demand * (1 + GREATEST(LEAST(tr, 0.25), -0.25)), 0) * 30, 0)
               AS BIGINT) AS pred,
       CAST(ROUND_EVEN(demand_std * SQRT(30.0), 0) AS BIGINT) AS safety,
       COALESCE(demand_std / NULLIF(avg_daily_demand, 0), 0) AS vol FROM known""",
    "fc": """
SELECT product_id, product_name, category, CAST(30 AS BIGINT) AS forecast_horizon_days, stock AS current_stock,
       ROUND(avg_daily_demand, 2) AS avg_daily_demand, ROUND(recent_avg_daily_demand, 2) AS recent_avg_daily_demand,
       pred AS predicted_demand, safety AS safety_stock, GREATEST(pred + safety - stock, 0) AS recommended_reorder_quantity,
       CASE WHEN tr >= 0.10 THEN 'Increasing' WHEN tr <= -0.10 THEN 'Decreasing' ELSE 'Stable' END AS trend_direction,
       ROUND(tr, 4) AS trend_percentage,
       CASE WHEN recent_avg_daily_demand > 0 THEN ROUND(stock / recent_avg_daily_demand, 2)
            ELSE CAST('inf' AS DOUBLE) END AS stock_coverage_days,
       CASE WHEN stock < pred THEN 'High' WHEN stock < pred + safety THEN 'Medium' ELSE 'Low' END
         AS forecast_stockout_risk,
       CASE WHEN history_days >= 60 AND vol <= 0.40 THEN 'High' WHEN history_days >= 30 AND vol <= 0.75 THEN 'Medium'
            ELSE 'Low' END AS confidence
FROM sized""",
    "fsum": """
SELECT COUNT(DISTINCT product_id) AS total_products_forecasted,
       CAST(COALESCE(SUM(predicted_demand), 0) AS BIGINT) AS total_predicted_demand,
       CAST(COALESCE(SUM(recommended_reorder_quantity), 0) AS BIGINT) AS total_recommended_reorder,
       COUNT(*) FILTER (forecast_stockout_risk = 'High') AS high_forecast_stockout_risk,
       COUNT(*) FILTER (forecast_stockout_risk = 'Medium') AS medium_forecast_stockout_risk FROM fc""",
    # holdout
    "aged": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY date DESC, product_name DESC, category DESC) AS rn,
       COUNT(*) OVER (PARTITION BY product_id) AS cnt FROM daily""",
    "held": """
SELECT date, product_id, product_name, category, sold_quantity AS actual_demand, ROUND(mean, 2) AS predicted_demand,
       ABS(sold_quantity - mean) AS absolute_error
FROM (SELECT *, AVG(sold_quantity) FILTER (rn > 14 AND rn <= 28) OVER (PARTITION BY product_id) AS mean FROM aged) x
WHERE cnt > 28 AND rn <= 14""",
    "scored": """
SELECT ROUND(COALESCE(AVG(ABS(actual_demand - predicted_demand)), 0), 4) AS mae,
       ROUND(COALESCE(SQRT(AVG((actual_demand - predicted_demand) * (actual_demand - predicted_demand))), 0), 4) AS rmse,
       ROUND(COALESCE(AVG(ABS((actual_demand - predicted_demand) / NULLIF(actual_demand, 0))) * 100, 0), 4) AS mape,
       COUNT(DISTINCT product_id) AS evaluated_products FROM held""",
    # recommendations
    "texts": """
SELECT *, CASE WHEN days_of_stock_left = CAST('inf' AS DOUBLE) THEN 'inf' ELSE PRINTF('%.1f', days_of_stock_left) END
            AS day_number,
       CASE WHEN days_of_stock_left = CAST('inf' AS DOUBLE) THEN 'Not available'
            ELSE PRINTF('%.1f', days_of_stock_left) || ' days' END AS days,
       PRINTF('%.1f', waste_rate * 100) || '%' AS waste FROM perf""",
    "rules": """
SELECT 0 AS rule_no, 'High' AS priority, 'Stockout Prevention' AS recommendation_type,
       CASE WHEN avg_daily_demand > 0 THEN 'High' ELSE 'Medium' END AS confidence,
       'Increase stock for ' || product_name || '.' AS action,
       product_name || ' has only ' || days || ' of stock left based on average daily demand. '
         || 'This creates a high stockout risk.' AS reason, * FROM texts WHERE stockout_risk = 'High'
UNION ALL
SELECT 0, 'Medium', 'Stock Monitoring', 'Medium',
       'Monitor ' || product_name || ' and prepare reorder if demand continues.',
       product_name || ' has around ' || days || ' of stock left. '
         || 'It is not critical yet, but should be monitored.', * FROM texts WHERE stockout_risk = 'Medium'
UNION ALL
SELECT 1, 'High', 'Overstock Reduction', 'High', 'Reduce future purchase quantity for ' || product_name || '.',
       product_name || ' has high overstock risk with ' || days || ' of estimated stock coverage. '
         || 'Excess stock can lock capital and increase holding cost.', * FROM texts WHERE overstock_risk = 'High'
UNION ALL
SELECT 1, 'Medium', 'Overstock Monitoring', 'Medium', 'Review purchase plan for ' || product_name || '.',
       product_name || ' has medium overstock risk with ' || days || ' of stock coverage.', *
FROM texts WHERE overstock_risk = 'Medium'
UNION ALL
SELECT 2, 'High', 'Waste Reduction', 'High', 'Investigate and reduce wastage for ' || product_name || '.',
       product_name || ' has a high waste rate of ' || waste || '. '
         || 'This may indicate over-ordering, expiry issues, poor handling, or demand mismatch.', *
FROM texts WHERE waste_rate > 0.10
UNION ALL
SELECT 2, 'Medium', 'Waste Monitoring', 'Medium', 'Monitor wastage pattern for ' || product_name || '.',
       product_name || ' has a moderate waste rate of ' || waste || '. '
         || 'It should be watched before it becomes a larger loss.', *
FROM texts WHERE waste_rate > 0.05 AND NOT waste_rate > 0.10
UNION ALL
SELECT 3, 'Low', 'Maintain Strategy', 'High', 'Maintain current inventory strategy for ' || product_name || '.',
       product_name || ' is performing well with healthy sell-through, low waste, and no major stock risk.', *
FROM texts WHERE stockout_risk = 'Low' AND overstock_risk = 'Low' AND waste_rate <= 0.05
             AND sell_through_rate >= 0.30 AND product_health_score >= 80
UNION ALL
SELECT 4, 'High', 'Product Review', 'Medium', 'Review overall inventory strategy for ' || product_name || '.',
       product_name || ' has a low product health score of ' || product_health_score || '/100. '
         || 'It may require pricing, purchasing, promotion, or supplier review.', *
FROM texts WHERE product_health_score < 60""",
    "rec": """
SELECT product_id, priority, product_name, category, recommendation_type, action, reason, confidence,
       CAST(TRUNC(COALESCE(current_stock, 0)) AS BIGINT) AS current_stock, ROUND(avg_daily_demand, 2) AS avg_daily_demand,
       CASE WHEN days_of_stock_left < CAST('inf' AS DOUBLE) THEN ROUND(days_of_stock_left, 2) END AS days_of_stock_left,
       CASE WHEN days_of_stock_left = CAST('inf' AS DOUBLE) THEN 'Not available'
            ELSE CAST(ROUND(days_of_stock_left, 2) AS VARCHAR) END AS days_label,
       ROUND(sell_through_rate, 4) AS sell_through_rate, ROUND(waste_rate, 4) AS waste_rate, product_health_score,
       total_revenue, rule_no, CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS grade
FROM rules""",
    "rsum": """
SELECT COUNT(*) AS total_recommendations, COUNT(*) FILTER (priority = 'High') AS high_priority,
       COUNT(*) FILTER (priority = 'Medium') AS medium_priority, COUNT(*) FILTER (priority = 'Low') AS low_priority
FROM rec""",
    # questions
    "asked": """
SELECT 'conv-' || conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user'
UNION ALL
SELECT 'part-' || p_partkey,
       CASE p_partkey % 12
         WHEN 0 THEN 'Should I reorder ' || p_name || ' next month?'
         WHEN 1 THEN 'Give me inventory summary for ' || LOWER(p_type)
         WHEN 2 THEN 'Which are the TOP ' || p_name || ' sellers?'
         WHEN 3 THEN 'Will we run out of ' || UPPER(p_name) || '?'
         WHEN 4 THEN 'Any excess ' || LOWER(p_type) || ' stock?'
         WHEN 5 THEN 'How much ' || p_name || ' was spoiled?'
         WHEN 6 THEN 'Predicted demand of all ' || LOWER(p_type) || ' parts'
         WHEN 7 THEN 'What action for ' || LOWER(p_type) || '?'
         WHEN 8 THEN 'Compare categories such as ' || LOWER(p_type)
         WHEN 9 THEN 'Should we keep ' || UPPER(p_name) || ' and buy more?'
         WHEN 10 THEN 'Is the ' || p_name || ' fine?'
         ELSE '   ' END FROM part""",
    "mention": """
SELECT question_id, ARG_MIN(product_name, place) AS product_name
FROM asked JOIN (SELECT product_name, ROW_NUMBER() OVER (ORDER BY total_revenue DESC, product_id) AS place FROM perf) n
  ON CONTAINS(LOWER(question), LOWER(product_name)) GROUP BY 1""",
    "routed": """
SELECT question_id, question, product_name,
       CASE WHEN TRIM(q) = '' THEN 'empty_question'
            WHEN product_name IS NOT NULL AND REGEXP_MATCHES(q,
              'should|recommend|keep|increase|reduce|order|reorder|buy|next month|next week|forecast|demand')
              THEN 'product_recommendation'
            WHEN REGEXP_MATCHES(q, 'summary|overview|health|performance') THEN 'inventory_summary'
            WHEN REGEXP_MATCHES(q, 'top|best|highest revenue|most revenue|sold most') THEN 'top_products'
            WHEN REGEXP_MATCHES(q, 'stockout|run out|low stock|shortage') THEN 'stockout_risk'
            WHEN REGEXP_MATCHES(q, 'overstock|excess|too much stock|high stock') THEN 'overstock_risk'
            WHEN REGEXP_MATCHES(q, 'waste|wastage|loss|spoiled') THEN 'waste_analysis'
            WHEN REGEXP_MATCHES(q, 'forecast|future demand|next month|next week|predicted demand')
              THEN 'forecast_summary'
            WHEN REGEXP_MATCHES(q, 'recommend|recommendation|action|what should i do') THEN 'general_recommendations'
            WHEN REGEXP_MATCHES(q, 'category|categories') THEN 'category_performance'
            ELSE 'inventory_summary' END AS intent
FROM (SELECT *, LOWER(question) AS q FROM asked) a LEFT JOIN mention USING (question_id)""",
    "alines": """
SELECT intent, CAST(grade AS INTEGER) AS grade, CAST(measure AS DOUBLE) AS measure, line FROM (
  SELECT * FROM (SELECT 'top_products' AS intent, 1 AS grade, -total_revenue AS measure,
         product_name || ' generated $' || FORMAT('{:,.2f}', total_revenue) || ' from '
           || FORMAT('{:,}', CAST(total_units_sold AS BIGINT)) || ' units sold.' AS line
         FROM perf ORDER BY total_revenue DESC, product_id LIMIT 5)
  UNION ALL
  SELECT 'stockout_risk', CASE stockout_risk WHEN 'High' THEN 1 ELSE 2 END, days_of_stock_left,
         product_name || ' has ' || stockout_risk || ' stockout risk with approximately ' || day_number
           || ' days of stock left.' FROM texts WHERE stockout_risk <> 'Low'
  UNION ALL
  SELECT 'overstock_risk', CASE overstock_risk WHEN 'High' THEN 1 ELSE 2 END, -days_of_stock_left,
         product_name || ' has ' || overstock_risk || ' overstock risk with approximately ' || day_number
           || ' days of stock coverage.' FROM texts WHERE overstock_risk <> 'Low'
  UNION ALL
  SELECT * FROM (SELECT 'waste_analysis', 1, -total_waste_value,
         product_name || ' has waste value of $' || FORMAT('{:,.2f}', total_waste_value) || ' and waste rate of '
           || waste || '.' FROM texts ORDER BY total_waste_value DESC, product_id LIMIT 5)
  UNION ALL
  SELECT * FROM (SELECT 'general_recommendations', 1,
         ROW_NUMBER() OVER (ORDER BY grade, total_revenue DESC, product_id, rule_no) AS place,
         '[' || priority || '] ' || action || ' Reason: ' || reason FROM rec) WHERE place <= 5
  UNION ALL
  SELECT 'category_performance', 1, -total_revenue, category || ' generated $' || FORMAT('{:,.2f}', total_revenue)
         || ' from ' || FORMAT('{:,}', CAST(total_units_sold AS BIGINT)) || ' units sold.' FROM cat) x""",
    "listed": """
SELECT intent, CAST((no - 1) // 200 + 1 AS INTEGER) AS part, CAST((MAX(total) + 199) // 200 AS INTEGER) AS parts,
       STRING_AGG(CASE WHEN intent = 'top_products' THEN no || '. ' ELSE '- ' END || line, CHR(10) ORDER BY no) AS body
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY intent ORDER BY grade, measure, line) AS no,
             COUNT(*) OVER (PARTITION BY intent) AS total FROM alines) x
GROUP BY 1, 2""",
    "msg": """
SELECT h.intent, COALESCE(part, 1) AS part, COALESCE(parts, 1) AS parts,
       CASE WHEN body IS NULL THEN ok ELSE TRUE END AS success,
       CASE WHEN body IS NULL THEN nothing
            ELSE header || CASE WHEN parts > 1 THEN ' (part ' || part || ' of ' || parts || ')' ELSE '' END
              || CHR(10) || CHR(10) || body END AS message
FROM (VALUES
  ('top_products', 'Top products by revenue:', 'No product data is available.', FALSE),
  ('stockout_risk', 'Stockout risk products:', 'No high or medium stockout-risk products were detected.', TRUE),
  ('overstock_risk', 'Overstock risk products:', 'No high or medium overstock-risk products were detected.', TRUE),
  ('waste_analysis', 'Highest waste products:', 'No waste analysis data is available.', FALSE),
  ('general_recommendations', 'Top inventory recommendations:',
   'No major recommendation is needed. Inventory appears stable based on current rules.', TRUE),
  ('category_performance', 'Category performance:', 'No category performance data is available.', FALSE)
) AS h(intent, header, nothing, ok) LEFT JOIN listed USING (intent)
UNION ALL
SELECT 'inventory_summary', 1, 1, TRUE, 'Inventory health score is ' || inventory_health_score || '/100. Total revenue is $'
       || FORMAT('{:,.2f}', total_revenue) || ', units sold are ' || FORMAT('{:,}', total_units_sold)
       || ', and waste value is $' || FORMAT('{:,.2f}', total_waste_value) || '. There are '
       || high_stockout_risk_products || ' high stockout-risk products and ' || high_overstock_risk_products
       || ' high overstock-risk products.' FROM summ, risk
UNION ALL
SELECT 'forecast_summary', 1, 1, TRUE, 'Forecast summary for the next 30 days: ' || total_products_forecasted
       || ' products were forecasted. Total predicted demand is ' || FORMAT('{:,}', total_predicted_demand)
       || ' units. Recommended reorder quantity is ' || FORMAT('{:,}', total_recommended_reorder) || ' units. '
       || high_forecast_stockout_risk || ' products have high forecast stockout risk.' FROM fsum""",
    "padvice": """
SELECT LOWER(product_name) AS product_key, CAST(grade AS INTEGER) AS grade, -total_revenue AS measure, product_id,
       CAST(rule_no AS INTEGER) AS rule_no, '[' || priority || '] ' || action || ' Reason: ' || reason AS line
FROM rec""",
    "card": """
SELECT LOWER(p.product_name) AS product_key, p.product_name,
       CAST(TRUNC(COALESCE(p.current_stock, 0)) AS BIGINT) AS current_stock, stockout_risk, overstock_risk, waste_rate,
       product_health_score, predicted_demand, safety_stock, recommended_reorder_quantity, forecast_stockout_risk,
       f.confidence AS forecast_confidence,
       (SELECT COUNT(*) FROM rec WHERE LOWER(rec.product_name) = LOWER(p.product_name)) AS recommendation_count
FROM perf p LEFT JOIN fc f ON LOWER(f.product_name) = LOWER(p.product_name)""",
    "pmsg": """
SELECT product_key, COALESCE(part, 1) AS part, COALESCE(parts, 1) AS parts, TRUE AS success,
       'Product analysis for ' || product_name || ':' || CHR(10) || '- Current stock: ' || current_stock || CHR(10)
       || '- Stockout risk: ' || stockout_risk || CHR(10) || '- Overstock risk: ' || overstock_risk || CHR(10)
       || '- Waste rate: ' || PRINTF('%.1f', waste_rate * 100) || '%' || CHR(10)
       || '- Product health score: ' || product_health_score || '/100'
       || COALESCE(CHR(10) || '- Predicted 30-day demand: ' || predicted_demand || CHR(10) || '- Safety stock: '
         || safety_stock || CHR(10) || '- Recommended reorder quantity: ' || recommended_reorder_quantity || CHR(10)
         || '- Forecast stockout risk: ' || forecast_stockout_risk || CHR(10) || '- Forecast confidence: '
         || forecast_confidence, '')
       || COALESCE(CHR(10) || CHR(10) || 'Recommended actions:'
         || CASE WHEN parts > 1 THEN ' (part ' || part || ' of ' || parts || ')' ELSE '' END || CHR(10) || body, CHR(10) || CHR(10)
         || 'No urgent recommendation was generated for this product based on current rules.') AS message
FROM card LEFT JOIN
  (SELECT product_key, CAST((no - 1) // 200 + 1 AS INTEGER) AS part, CAST((MAX(total) + 199) // 200 AS INTEGER) AS parts,
          STRING_AGG('- ' || line, CHR(10) ORDER BY no) AS body
   FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_key ORDER BY grade, measure, product_id, rule_no, line) AS no,
                COUNT(*) OVER (PARTITION BY product_key) AS total FROM padvice) x
   GROUP BY 1, 2) b USING (product_key)""",
    "intro": """
SELECT * FROM (VALUES
  ('inventory_summary', 'Here is the current inventory overview based on uploaded data.'),
  ('top_products', 'Here are the strongest products based on revenue performance.'),
  ('stockout_risk', 'I checked which products may run out soon.'),
  ('overstock_risk', 'I checked which products may have excess stock.'),
  ('waste_analysis', 'I analyzed products contributing most to waste or loss.'),
  ('forecast_summary', 'Here is the demand forecast summary.'),
  ('general_recommendations', 'Here are the most important inventory actions to consider.'),
  ('category_performance', 'Here is the category-level performance breakdown.'),
  ('product_recommendation', 'I checked this product using KPIs, forecast, and recommendation rules.')
) AS i(intent, intro)""",
    "answered": """
SELECT question_id, question, r.intent, product_name, COALESCE(p.part, g.part, 1) AS part, COALESCE(p.parts, g.parts, 1) AS parts,
       CASE WHEN r.intent = 'empty_question' THEN 'Please ask a question about inventory, products, forecast, risk, '
              || 'waste, or recommendations.'
            WHEN COALESCE(p.success, g.success) THEN intro || CHR(10) || CHR(10) || COALESCE(p.message, g.message)
            ELSE 'I could not complete the analysis. ' || COALESCE(p.message, g.message, '') END AS answer,
       CASE WHEN r.intent = 'empty_question' THEN '' ELSE r.intent END AS tools_used,
       CASE WHEN r.intent <> 'empty_question' AND COALESCE(p.success, g.success) THEN 'High' ELSE 'Low' END AS confidence
FROM routed r LEFT JOIN msg g ON g.intent = r.intent LEFT JOIN intro ON intro.intent = r.intent
LEFT JOIN pmsg p ON r.intent = 'product_recommendation' AND p.product_key = LOWER(r.product_name)""",
}


PRODUCT_KEYS = "product_id, product_name, category"
FORECAST_COLUMNS = """product_name, category, current_stock, avg_daily_demand, recent_avg_daily_demand, predicted_demand,
  safety_stock, recommended_reorder_quantity, trend_direction, forecast_stockout_risk, confidence"""
ADVICE = "SELECT * EXCLUDE (total_revenue, rule_no, grade)"
LEDGER_DAY = "CAST(date AS VARCHAR) AS date"

FINAL = {
    "ledger": f"SELECT * REPLACE ({LEDGER_DAY}) FROM inv",
    "csv_round_trip": f"SELECT * REPLACE ({LEDGER_DAY}) FROM inv",
    "csv_rejects": """SELECT CAST(date AS VARCHAR) || ',' || store_id || ',' || product_id
  || CASE WHEN dd = 3 THEN '' ELSE ',' || CAST(sold_quantity AS BIGINT) END || CASE WHEN dd = 17 THEN ',x' ELSE '' END AS line,
  CASE WHEN dd IN (3, 17) THEN 'reject' ELSE 'kept' END AS status FROM (SELECT *, EXTRACT(DAY FROM date) AS dd FROM inv) x""",
    "date_layouts": """
SELECT written, written AS found, bad_date, day_sum
FROM (VALUES ('yyyy-M-d'), ('yyyy/M/d'), ('M/d/yyyy'), ('d/M/yyyy'), ('d.M.yyyy'), ('d-M-yyyy'), ('yyyyMMdd'), ('d-MMM-yyyy'),
             ('d MMM yyyy'), ('MMM d, yyyy'), ('d MMMM yyyy'), ('MMMM d, yyyy')) AS l(written),
     (SELECT COUNT(*) FILTER (date IS NULL) AS bad_date, CAST(SUM(date - DATE '1970-01-01') AS BIGINT) AS day_sum FROM typed) x""",
    "ledger_between": f"SELECT * REPLACE ({LEDGER_DAY}) FROM inv WHERE date BETWEEN DATE '1995-02-10' AND DATE '1995-05-09'",
    "product_performance_stored": "SELECT * FROM perf",
    "product_forecast_bucketed": "SELECT * FROM fc",
    "json_records": "SELECT * FROM fc",
    "preview": f"SELECT * REPLACE ({LEDGER_DAY}) FROM (SELECT * FROM inv ORDER BY date, store_id, product_id LIMIT 50) x",
    "json_safe": "SELECT * REPLACE (CASE WHEN days_of_stock_left < CAST('inf' AS DOUBLE) THEN days_of_stock_left END "
    "AS days_of_stock_left) FROM perf",
    "evaluation_run": """
SELECT 'moving-average-baseline-14d-window' AS run_name, name, text_value, number_value FROM (
  SELECT 'forecast_method' AS name, 'moving_average_baseline' AS text_value, CAST(NULL AS DOUBLE) AS number_value
  UNION ALL SELECT 'data_file', 'lineitem', NULL
  UNION ALL SELECT 'recent_window_days', '14', NULL
  UNION ALL SELECT 'test_window_days', '14', NULL
  UNION ALL SELECT 'data_quality_score', CAST(data_quality_score AS VARCHAR), NULL FROM report
  UNION ALL SELECT 'mae', NULL, mae FROM scored
  UNION ALL SELECT 'rmse', NULL, rmse FROM scored
  UNION ALL SELECT 'mape', NULL, mape FROM scored
  UNION ALL SELECT 'evaluated_products', NULL, evaluated_products FROM scored) x""",
    "analysis_outputs": """
SELECT 'validation' AS output, CAST(1 AS BIGINT) AS row_count
UNION ALL SELECT 'summary_metrics', COUNT(*) FROM summ
UNION ALL SELECT 'risk_summary', COUNT(*) FROM risk
UNION ALL SELECT 'forecast_summary', COUNT(*) FROM fsum
UNION ALL SELECT 'recommendation_summary', COUNT(*) FROM rsum
UNION ALL SELECT 'product_performance', COUNT(*) FROM perf
UNION ALL SELECT 'category_performance', COUNT(*) FROM cat
UNION ALL SELECT 'forecast_results', COUNT(*) FROM fc
UNION ALL SELECT 'recommendations', COUNT(*) FROM rec""",
    "coerce_counts": "SELECT * FROM coerced",
    "quality_counts": "SELECT * FROM counted",
    "sales_outliers": "SELECT * FROM outliers",
    "duplicate_rows": "SELECT * FROM copies",
    "validation_report": "SELECT * FROM report",
    "validation_report_clean": "SELECT * FROM report",
    "enrich": f"SELECT * REPLACE ({LEDGER_DAY}) FROM enr",
    "latest_snapshot": f"SELECT * REPLACE ({LEDGER_DAY}) FROM snap",
    "latest_stock": "SELECT * FROM stock",
    "product_performance": "SELECT * FROM perf",
    "category_performance": "SELECT * FROM cat",
    "risk_summary": "SELECT * FROM risk",
    "high_risk_products": "SELECT high_stockout_risk_products + high_overstock_risk_products AS high_risk_products "
    "FROM risk",
    "summary_metrics": "SELECT * FROM summ",
    "daily_revenue": f"SELECT {LEDGER_DAY}, CAST(SUM(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM enr "
    "GROUP BY 1",
    "daily_demand": f"SELECT * REPLACE ({LEDGER_DAY}) FROM daily",
    "demand_calendar": f"SELECT * REPLACE ({LEDGER_DAY}) FROM dense",
    "demand_windows": "SELECT * REPLACE (ROUND(demand_std, 6) AS demand_std) FROM win",
    "product_forecast": "SELECT * FROM fc",
    "forecast_summary": "SELECT * FROM fsum",
    "forecast_eval": f"SELECT * REPLACE ({LEDGER_DAY}) FROM held",
    "forecast_metrics": "SELECT * FROM scored",
    "recommendations": f"{ADVICE} FROM rec",
    "recommendation_summary": "SELECT * FROM rsum",
    "top_products": f"SELECT * FROM perf ORDER BY total_revenue DESC, {PRODUCT_KEYS} LIMIT 5",
    "top_products_chart": f"SELECT * FROM perf ORDER BY total_revenue DESC, {PRODUCT_KEYS} LIMIT 8",
    "top_waste": f"SELECT * FROM perf ORDER BY total_waste_value DESC, {PRODUCT_KEYS} LIMIT 5",
    "top_waste_chart": f"SELECT * FROM perf ORDER BY total_waste_value DESC, {PRODUCT_KEYS} LIMIT 8",
    "top_reorder": "SELECT * FROM fc ORDER BY recommended_reorder_quantity DESC, product_id LIMIT 8",
    "top_recommendations": f"{ADVICE} FROM (SELECT * FROM rec ORDER BY grade, total_revenue DESC, {PRODUCT_KEYS}, "
    "rule_no LIMIT 5) x",
    "stockout_list": "SELECT * FROM perf WHERE stockout_risk IN ('High', 'Medium')",
    "overstock_list": "SELECT * FROM perf WHERE overstock_risk IN ('High', 'Medium')",
    "executive_insights": """
SELECT CAST(1 AS BIGINT) AS position, 'top_product' AS insight, product_name AS subject, total_revenue AS value,
       'Top revenue product is ' || product_name || ', generating $' || FORMAT('{:,.2f}', total_revenue)
         || ' in revenue.' AS text
FROM (SELECT * FROM perf ORDER BY total_revenue DESC, product_id LIMIT 1) a
UNION ALL
SELECT 2, 'best_category', category, total_revenue, 'Best-performing category is ' || category || ', with $'
         || FORMAT('{:,.2f}', total_revenue) || ' total revenue.'
FROM (SELECT * FROM cat ORDER BY total_revenue DESC, category LIMIT 1) b
UNION ALL
SELECT 3, 'highest_waste', product_name, total_waste_value, 'Highest waste value is from ' || product_name
         || ', causing an estimated loss of $' || FORMAT('{:,.2f}', total_waste_value) || '.'
FROM (SELECT * FROM perf ORDER BY total_waste_value DESC, product_id LIMIT 1) c
UNION ALL
SELECT 4, 'inventory_health', 'inventory', CAST(inventory_health_score AS DOUBLE), 'Overall inventory health score is '
         || inventory_health_score || '/100, based on sell-through, waste, stockout, and overstock risk.' FROM summ""",
    "product_table": """SELECT product_name, category, total_revenue, total_units_sold, total_units_wasted, current_stock,
  sell_through_rate, waste_rate, stockout_risk, overstock_risk, product_health_score FROM perf""",
    "category_table": "SELECT * EXCLUDE (total_available_stock) FROM cat",
    "forecast_table": f"SELECT {FORECAST_COLUMNS} FROM fc",
    "recommendation_table": """SELECT priority, product_name, category, recommendation_type, action, reason, confidence,
  current_stock, avg_daily_demand, days_of_stock_left, product_health_score FROM rec""",
    "product_brief": f"""SELECT product_name, category, total_revenue, total_units_sold, current_stock, stockout_risk,
  overstock_risk, product_health_score FROM perf ORDER BY total_revenue DESC, {PRODUCT_KEYS} LIMIT 5""",
    "forecast_brief": """SELECT product_name, category, current_stock, predicted_demand, safety_stock,
  recommended_reorder_quantity, trend_direction, forecast_stockout_risk, confidence FROM fc""",
    "recommendation_brief": f"""SELECT priority, product_name, recommendation_type, action, confidence
FROM (SELECT * FROM rec ORDER BY grade, total_revenue DESC, {PRODUCT_KEYS}, rule_no LIMIT 10) x""",
    "stockout_table": """SELECT product_name, category, current_stock, avg_daily_demand, days_of_stock_left, stockout_risk
FROM perf WHERE stockout_risk IN ('High', 'Medium')""",
    "overstock_table": """SELECT product_name, category, current_stock, avg_daily_demand, days_of_stock_left,
  overstock_risk FROM perf WHERE overstock_risk IN ('High', 'Medium')""",
    "question_product": "SELECT * FROM mention",
    "question_intent": "SELECT question_id, product_name, intent FROM routed",
    "product_card": "SELECT * FROM card",
    "answer_lines": "SELECT * FROM alines",
    "product_advice_lines": "SELECT * FROM padvice",
    "intent_messages": "SELECT * FROM msg",
    "product_messages": "SELECT * FROM pmsg",
    "answers": "SELECT * FROM answered",
    "answers_saved": "SELECT * FROM answered",
}
# Queries over the clean ledger where the report block otherwise reads the defective one.
CLEAN = {"validation_report_clean", "evaluation_run"}


def oracle_sql() -> dict[str, str]:
    """One statement per query: all blocks, then the final select."""
    out = {}
    for name, final in FINAL.items():
        blocks = dict(BLOCKS)
        if name in CLEAN:
            blocks["dirty"] = "SELECT * FROM inv"
            blocks["typed"] = "SELECT * FROM inv"
        chain = ",\n".join(f"{block} AS ({body})" for block, body in blocks.items())
        out[name] = f"WITH {chain}\n{final}"
    return out
